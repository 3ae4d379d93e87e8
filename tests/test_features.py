"""Traps of the feature operators: strict visibility, order, ties, leakage."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from knowntime import views as V
from knowntime.catalog.features import elo_table, form_rows, model_rows, probe_rows
from knowntime.operators import form, ratings

T0 = dt.datetime(2024, 1, 1, 12)
SCHEMA = ("contest_id long, league string, home_id long, away_id long, scheduled_at timestamp_ntz, home_score int, "
          "away_score int, neutral int, decision_at timestamp_ntz, available_at timestamp_ntz, season int")


def game(i, home, away, day, hs, aws, neutral=0, lag=24.0):
    at = T0 + dt.timedelta(days=day)
    return (i, "L", home, away, at, hs, aws, neutral, at - dt.timedelta(hours=1), at + dt.timedelta(hours=lag), at.year)


def rows(frame, key="contest_id"):
    return {r[key]: r.asDict() for r in frame.collect()}


def test_result_available_exactly_at_the_decision_is_invisible(spark):
    # The second game's decision is 24 hours after the first start: the same instant as its availability.
    g = [game(1, 1, 2, 0, 100, 90), game(2, 1, 3, 1 + 1 / 24, 80, 70), game(3, 1, 2, 1 + 1 / 24 + 1e-4, 90, 95)]
    got = rows(form_rows(spark.createDataFrame(g, SCHEMA), 20, 14))
    assert got[2]["history_count_diff"] == 0 and got[2]["margin_diff"] == 0
    assert got[3]["margin_diff"] == 20.0      # +10 for the winner, -10 for the loser
    assert got[2]["home_rest"] == pytest.approx(1 + 1 / 24)   # the start itself was known


def test_rating_by_hand(spark):
    g = [game(1, 1, 2, 0, 100, 90), game(2, 2, 1, 3, 80, 70, neutral=1), game(3, 1, 2, 6, 1, 0)]
    got = rows(elo_table(spark.createDataFrame(g, SCHEMA), ["league"], advantage=65))
    p1 = 1 / (1 + 10 ** (-65 / 400))
    d1 = 20 * (1 - p1)
    assert got[1]["elo_diff"] == 0 and got[1]["p_elo"] == pytest.approx(p1)
    assert got[2]["elo_diff"] == pytest.approx(-2 * d1)
    p2 = 1 / (1 + 10 ** (2 * d1 / 400))
    assert got[2]["p_elo"] == pytest.approx(p2)
    assert got[3]["elo_diff"] == pytest.approx(2 * d1 - 2 * 20 * (1 - p2))


def test_tie_moves_ratings_by_a_half(spark):
    g = [game(1, 1, 2, 0, 90, 90)]
    c = ratings.with_outcome(spark.createDataFrame(g, SCHEMA))
    r = ratings.rating_fold(c, ["league"], advantage=55).first()
    assert r["home_rating"] == pytest.approx(1500 + 20 * (0.5 - 1 / (1 + 10 ** (-55 / 400))))
    assert r["home_rating"] + r["away_rating"] == pytest.approx(3000)


def test_future_results_change_nothing_before_them(spark, sf):
    c = V.contests(spark, sf).where("home_score <> away_score").cache()
    cut = dt.datetime(1999, 1, 1)
    late = F.col("available_at") >= F.lit(cut).cast("timestamp_ntz")
    changed = c.withColumn("home_score", F.when(late, F.col("home_score") + 37).otherwise(F.col("home_score")))
    before = F.col("decision_at") < F.lit(cut).cast("timestamp_ntz")
    cols = ["contest_id", "margin_diff", "win_rate_diff", "elo_diff", "home_rest", "history_count_diff"]
    a, b = (sorted(map(tuple, model_rows(x).where(before).select(*cols).collect())) for x in (c, changed))
    assert a == b and len(a) > 100


def test_row_order_and_partitions_do_not_matter(spark, sf):
    c = V.contests(spark, sf)
    cols = ["contest_id", "elo_diff"]
    one = sorted(map(tuple, elo_table(c.coalesce(1), ["league"], advantage=55).select(*cols).collect()))
    two = sorted(map(tuple, elo_table(c.repartition(13, F.rand(3)), ["league"], advantage=55).select(*cols).collect()))
    assert one == two


def test_chunks_do_not_change_features(spark, sf):
    s = V.sides(V.contests(spark, sf))
    facts = s.select("league", "team", "available_at", "scheduled_at", "contest_id", "scored", "allowed", "win")
    probes = s.select("contest_id", "league", "team", "side", "scheduled_at", "decision_at")
    cols = ["contest_id", "side", "form_n", "form_margin", "rest"]
    out = []
    for chunk in (None, 40, 366):
        p = form.rest_days(facts, form.rolling_form(facts, probes, window=5, chunk_days=chunk), cap=14, chunk_days=chunk)
        out.append(sorted(tuple(r) for r in p.select(*cols).collect()))
    assert out[0] == out[1] == out[2]
    sched = [sorted(tuple(r) for r in form.scheduled_form(facts, probes, window=5, min_history=2, cap=14, chunk_days=k)
                    .select("contest_id", "side", "form_n", "form_margin", "rest").collect()) for k in (None, 40)]
    assert sched[0] == sched[1]


def test_pending_contests_never_enter_a_history(spark):
    played = [game(i, 1 + i % 2, 2 - i % 2, i * 3, 90 + i, 80) for i in range(6)]
    pending = [game(9, 1, 2, 30, 0, 0), game(10, 2, 1, 31, 0, 0)]
    settled, both = spark.createDataFrame(played, SCHEMA), spark.createDataFrame(played + pending, SCHEMA)
    got = rows(probe_rows(settled, both))
    wild = spark.createDataFrame(played + [game(9, 1, 2, 30, 500, 0), game(10, 2, 1, 31, 0, 500)], SCHEMA)
    again = rows(probe_rows(settled, wild))
    for k in (9, 10):
        assert {c: got[k][c] for c in ("margin_diff", "elo_diff", "history_count_diff")} == \
               {c: again[k][c] for c in ("margin_diff", "elo_diff", "history_count_diff")}
    assert math.isclose(got[10]["elo_diff"], -got[9]["elo_diff"])


def test_scheduled_form_takes_the_newest_known_contests(spark):
    """Early-known and withheld results, against a plain search; chunks of any width agree."""
    import random
    r = random.Random(4)
    day = dt.timedelta(days=1)
    start = dt.datetime(2020, 1, 1)
    facts = []
    for i in range(160):
        at = start + day * r.randrange(900)
        late = r.choice([1, 1, 1, 2, 30, 400, -50])
        facts.append(("L", i % 2, at + day * late, at, i, r.randrange(5), r.randrange(5)))
    facts += [(None, 0, start, start, 900, 9, 9), ("L", 0, None, start, 901, 9, 9), ("L", 0, start, None, 902, 9, 9)]
    probes = [(i, "L", i % 2, start + day * r.randrange(1000)) for i in range(120)] + [(500, None, 0, start), (501, "L", 0, None)]
    f = spark.createDataFrame(facts, "league string, team int, available_at timestamp_ntz, scheduled_at timestamp_ntz, contest_id int, scored int, allowed int")
    p = spark.createDataFrame([(*x, x[3]) for x in probes], "probe int, league string, team int, decision_at timestamp_ntz, scheduled_at timestamp_ntz")
    for chunk in (None, 40, 366):
        got = {x.probe: x for x in form.scheduled_form(f, p, window=4, min_history=3, cap=14, chunk_days=chunk).collect()}
        assert len(got) == len(probes)
        for i, league, team, at in probes:
            seen = [x for x in facts if None not in x and league and at and x[1] == team and x[2] < at]
            seen = sorted(seen, key=lambda x: (x[3], x[4]))[-4:]
            x = got[i]
            assert x.form_n == len(seen)
            if seen:
                assert abs(x.form_margin - sum(s[5] - s[6] for s in seen) / len(seen)) < 1e-12
                assert x.form_win == sum(s[5] > s[6] for s in seen) / len(seen)
                assert abs(x.rest - min(14, (at - seen[-1][3]) / day)) < 1e-9
            else:
                assert (x.form_margin, x.form_win, x.rest) == (0.0, 0.5, 14.0)


def test_assembled_inputs_equal_the_separate_operators_and_are_dealt_once(spark, sf):
    c = V.contests(spark, sf)
    got = model_rows(c)
    want = form_rows(c, 20, 14).join(elo_table(c, ["league"], advantage=65).select("contest_id", "elo_diff", "p_elo"), "contest_id")
    assert got.select(want.columns).exceptAll(want).count() == 0 and got.count() == want.count() == c.count()
    exchanges = got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert exchanges <= 12, exchanges


def test_history_over_small_batches_ties_and_unknown_scores(spark, sf):
    c = V.contests(spark, sf).withColumn("home_score", F.when(F.col("contest_id") % 11 != 0, F.col("home_score")))
    c = c.withColumn("decision_at", F.when(F.col("contest_id") % 13 != 0, F.col("decision_at")))
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        want = form_rows(c, 20, 14).join(elo_table(c, ["league"], advantage=65).select("contest_id", "elo_diff", "p_elo"), "contest_id")
        got = model_rows(c).select(want.columns)
        assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_nested_reports_give_the_states_of_the_as_of_join(spark):
    import datetime as dt
    import random
    from knowntime.operators import availability as A
    r, day = random.Random(5), dt.datetime(2024, 1, 1)
    names = [*A.STATUSES, A.NOT_SUBMITTED, None, "Odd"]
    games, reports = [], []
    for g in range(150):
        for side, team in (("home", g % 7), ("away", g % 7 + 1 if g % 11 else None)):
            games.append((g, side, team, day + dt.timedelta(hours=g) if g % 13 else None))
            for _ in range(r.randrange(6)):
                at = day + dt.timedelta(hours=g - r.choice((-1, 0, 1, 2, 49, 49)))
                reports.append((g, team, at if r.random() < 0.9 else None, r.choice([1, 2, 3, 4, 5, 6, None]), r.choice(names[:4] * 3 + names), r.choice(["a"] * 9 + ["b"])))
    keys = ["contest_id", "team_id"]
    g = spark.createDataFrame(games, "contest_id long, side string, team_id long, decision_at timestamp_ntz")
    f = spark.createDataFrame(reports, "contest_id long, team_id long, report_at timestamp_ntz, player_id long, status string, source string")
    want = A.snapshot_states(g, A.snapshots(f, keys), keys)
    nested = f.groupBy(*keys).agg(F.collect_list(F.struct("report_at", "player_id", "status", "source")).alias("reports"))
    got = A.nested_states(g.join(nested, keys, "left").select(*g.columns, "reports"))
    plain = lambda d: sorted(map(repr, d.select(*want.columns).collect()))
    assert plain(got) == plain(want) and {x.state for x in got.collect()} == {"missing", "invalid", "stale", "not_submitted", "usable"}
    listed = got.select("contest_id", "side", F.explode_outer("listed").alias("l")).where("l IS NOT NULL").select("contest_id", "side", "l.player_id", "l.status")
    old = A.listed_players(want, f, keys).select("contest_id", "side", "player_id", "status")
    assert sorted(map(repr, listed.collect())) == sorted(map(repr, old.collect())) and listed.count()


def test_contest_lines_are_dealt_once_and_keep_every_line(spark, sf):
    from knowntime import views as V
    from knowntime.catalog import models as Q
    from knowntime.operators import availability as A
    contests = V.contests(spark, sf)
    lines = Q.contest_lines(spark, sf, contests)
    plan = lines._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("RoundRobin") == 0 and lines._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2
    li = V.table(spark, sf, "lineitem").join(contests.select(F.col("contest_id").alias("l_orderkey")), "l_orderkey")
    each = lines.select("contest_id", F.explode("players").alias("p")).select("contest_id", "p.*")
    want = li.groupBy(F.col("l_orderkey").alias("contest_id"), (F.col("l_partkey") % 300).alias("player_id")).agg(
        F.sum("l_quantity").alias("minutes"), F.sum(F.floor("l_quantity") % 7).cast("double").alias("points"), F.count("*").cast("int").alias("n"))
    got = each.select("contest_id", F.col("player_id").cast("long").alias("player_id"), "minutes", "points", F.size("rows").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    sides = Q.contest_sides(lines)
    assert sides.count() == 2 * contests.count() and sides.agg(F.sum(F.size("reports"))).first()[0] == li.count()
    assert A.nested_states(sides)._jdf.queryExecution().executedPlan().toString().count("Exchange") == lines._jdf.queryExecution().executedPlan().toString().count("Exchange")
