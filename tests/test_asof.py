"""As-of operators against brute force, with and without chunks, including ties."""

import random

import datetime as dt

import pytest
from pyspark.sql import functions as F

from knowntime.functions.times import DAY_US
from knowntime.operators import asof as A


def data(spark, seed, facts=160, probes=80, span=60):
    """A hot entity ('a') holds most rows; many times coincide."""
    rng = random.Random(seed)
    who = lambda: "a" if rng.random() < 0.6 else rng.choice("bcd")
    f = [(who(), rng.randrange(span) * DAY_US // 2, i, float(rng.randrange(100))) for i in range(facts)]
    p = [(who() if rng.random() < 0.95 else "z", rng.randrange(span + 5) * DAY_US // 2, i) for i in range(probes)]
    fd = spark.createDataFrame(f, "k string, ft long, fid long, v double")
    pd_ = spark.createDataFrame(p, "k string, pt long, pid long")
    return f, p, fd, pd_


def visible(f, k, t, strict):
    rows = [r for r in f if r[0] == k and (r[1] < t if strict else r[1] <= t)]
    return sorted(rows, key=lambda r: (r[1], r[2]))


CASES = [(s, strict, chunk) for s, strict, chunk in
         [(1, True, None), (1, True, 3), (2, False, 1), (3, True, 366), (4, False, 2.5)]]


@pytest.mark.parametrize("seed,strict,chunk", CASES)
def test_last(spark, seed, strict, chunk):
    f, p, fd, pd_ = data(spark, seed)
    out = A.asof_last(fd, pd_, ["k"], fact_time="ft", probe_time="pt", order=["fid"], values=["fid", "v"],
                      strict=strict, chunk_days=chunk)
    got = {r["pid"]: (r["fid"], r["v"]) for r in out.collect()}
    assert len(got) == len(p)
    for k, t, pid in p:
        seen = visible(f, k, t, strict)
        assert got[pid] == ((seen[-1][2], seen[-1][3]) if seen else (None, None))


@pytest.mark.parametrize("seed,strict,chunk", CASES)
def test_rolling(spark, seed, strict, chunk):
    f, p, fd, pd_ = data(spark, seed)
    out = A.asof_rolling(fd, pd_, ["k"], fact_time="ft", probe_time="pt", order=["fid"], window=4, measures=["v"],
                         aggs={"m": F.avg("v"), "n": F.count("v")}, strict=strict, chunk_days=chunk)
    got = {r["pid"]: (r["m"], r["n"]) for r in out.collect()}
    for k, t, pid in p:
        seen = [r[3] for r in visible(f, k, t, strict)][-4:]
        assert got[pid] == ((sum(seen) / len(seen), len(seen)) if seen else (None, None))


@pytest.mark.parametrize("seed,strict,chunk", CASES)
def test_cumulative(spark, seed, strict, chunk):
    f, p, fd, pd_ = data(spark, seed)
    out = A.asof_cumulative(fd, pd_, ["k"], fact_time="ft", probe_time="pt", sums={"n": F.lit(1), "s": F.col("v")},
                            maxima={"top": F.struct("v", "fid")}, strict=strict, chunk_days=chunk)
    got = {r["pid"]: r for r in out.collect()}
    for k, t, pid in p:
        seen = visible(f, k, t, strict)
        r = got[pid]
        assert (r["n"], r["s"]) == (len(seen), sum(x[3] for x in seen))
        want = max(((x[3], x[2]) for x in seen), default=None)
        assert (tuple(r["top"]) if r["top"] else None) == want


@pytest.mark.parametrize("chunk", [None, 2])
def test_nearest(spark, chunk):
    f, p, fd, pd_ = data(spark, 7)
    tol = 2 * DAY_US
    out = A.asof_nearest(fd, pd_, ["k"], fact_time="ft", probe_time="pt", order=["fid"], value="fid", tolerance_us=tol,
                         chunk_days=chunk)
    got = {r["pid"]: (r["fid"], r["distance_us"]) for r in out.collect()}
    for k, t, pid in p:
        near = [(abs(x[1] - t), x[1] > t) for x in f if x[0] == k and abs(x[1] - t) <= tol]
        if not near:
            assert got[pid] == (None, None)
        else:
            fid, d = got[pid]
            assert d == min(near)[0] and abs(f[fid][1] - t) == d
            assert (f[fid][1] > t) == min(near)[1]      # equal distances: the earlier fact


def test_positions(spark):
    f, _, fd, _ = data(spark, 9)
    for chunk in (None, 3):
        got = {r["fid"]: r["position"] for r in A.running_positions(
            fd, ["k"], time="ft", order=["fid"], chunk_days=chunk).collect()}
        for k in "abcd":
            order = [r[2] for r in sorted((x for x in f if x[0] == k), key=lambda r: (r[1], r[2]))]
            assert [got[i] for i in order] == list(range(1, len(order) + 1))


def test_window_join_is_complete(spark):
    f, p, fd, pd_ = data(spark, 11)
    span = 3 * DAY_US
    out = A.window_join(fd, pd_, ["k"], fact_time="ft", low_us=F.col("pt") - span, high_us=F.col("pt"), span_us=span)
    got = sorted((r["pid"], r["fid"]) for r in out.collect())
    want = sorted((pid, x[2]) for k, t, pid in p for x in f if x[0] == k and t - span <= x[1] <= t)
    assert got == want


@pytest.mark.parametrize("chunk", [None, 1, 366])
def test_unknown_times_and_keys_see_and_show_nothing(spark, chunk):
    day = lambda n: dt.datetime(2020, 1, n)
    facts = spark.createDataFrame([("a", None, 5.0, 1), ("a", day(10), 7.0, 2), (None, day(1), 9.0, 3)], "k string, ft timestamp_ntz, v double, i int")
    probes = spark.createDataFrame([(1, "a", day(5)), (2, "a", day(11)), (3, "a", None), (4, None, day(11)), (4, None, day(11))],
                                   "p int, k string, pt timestamp_ntz")
    at = {"fact_time": "ft", "probe_time": "pt", "chunk_days": chunk}
    last = A.asof_last(facts, probes, ["k"], order=["i"], values=["v"], **at).collect()
    rolled = A.asof_rolling(facts, probes, ["k"], order=["i"], window=3, measures=["v"], aggs={"n": F.count("v")}, **at).collect()
    total = A.asof_cumulative(facts, probes, ["k"], sums={"n": F.lit(1)}, **at).collect()
    assert sorted((r.p, r.v) for r in last if r.p < 4) == [(1, None), (2, 7.0), (3, None)] and [r.v for r in last if r.p == 4] == [None, None]
    assert sorted((r.p, r.n or 0) for r in rolled) == [(1, 0), (2, 1), (3, 0), (4, 0), (4, 0)]
    assert sorted((r.p, r.n) for r in total) == [(1, 0), (2, 1), (3, 0), (4, 0), (4, 0)]


def test_latest_quotes_by_plain_search(spark):
    """Late, early-expiring and tied revisions; a quote may be the latest again once a newer one has expired."""
    import random
    from knowntime.operators import quotes as Q
    r = random.Random(8)
    hour = dt.timedelta(hours=1)
    start = dt.datetime(2024, 3, 1)
    rows = []
    for i in range(600):
        at = start + hour * r.randrange(400)
        rows.append((i, r.choice(["a", "b", None]), r.choice("xyz"), at, at + hour * r.choice([0, 0, 1, 5, 30, -2]), float(i), 2.0))
    rows += [(900, "a", "x", None, start, 1.0, 2.0), (901, "a", "x", start, None, 1.0, 2.0)]
    cuts = [(c, start + hour * h) for c in "abc" for h in range(0, 420, 7)] + [(None, start), ("a", None)]
    q = spark.createDataFrame(rows, "quote_id int, contest_id string, book string, quote_at timestamp_ntz, available_at timestamp_ntz, "
                                    "home_odds double, away_odds double")
    d = spark.createDataFrame(cuts, "contest_id string, decision_at timestamp_ntz")
    got = {(x.contest_id, x.decision_at, x.book): x.quote_id for x in Q.latest_quotes(q, d, max_age_us=24 * 3_600_000_000).collect()}
    want = {}
    for c, cut in cuts:
        for row in rows:
            if c and cut and row[1] == c and row[3] and row[4] and max(row[3], row[4]) <= cut and cut - row[3] <= 24 * hour:
                k = (c, cut, row[2])
                if k not in want or (row[4], row[3], row[0]) > want[k][0]:
                    want[k] = ((row[4], row[3], row[0]), row[0])
    assert got == {k: v[1] for k, v in want.items()} and len(got) > 100


def test_consensus_leaves_out_the_execution_book(spark):
    from knowntime.operators import quotes as Q
    t = dt.datetime(2024, 1, 1)
    rows = [(1, b, t, t, o, 2.0, "d") for b, o in (("a", 1.5), ("b", 2.0), ("c", 3.0), ("d", 9.0))] + [(2, b, t, t, 2.0, 2.0, "d") for b in "ad"]
    df = spark.createDataFrame(rows, "contest_id int, book string, decision_at timestamp_ntz, quote_at timestamp_ntz, home_odds double, away_odds double, own string")
    for own in ("d", F.col("own")):
        got = {x.contest_id: x for x in Q.consensus(df, ["contest_id"], min_books=3, execution_book=own).collect()}
        assert got[1].books == 3 and got[1].q == 0.5 and got[1].abstain_reason is None
        assert (got[2].books, got[2].q, got[2].abstain_reason) == (1, None, "fewer than 3 reference books")


def test_a_burst_is_cut_by_rank(spark):
    """One entity has a third of all facts in one day, many of them at one instant: pieces are even, results the same."""
    rng = random.Random(11)
    day = 86_400_000_000
    facts = [("hot", 40 * day + (0 if rng.random() < 0.5 else rng.randrange(day)), i, float(rng.randrange(50))) for i in range(2000)]
    facts += [(rng.choice(["a", "b", "c", "hot"]), rng.randrange(900) * day, 2000 + i, float(rng.randrange(50))) for i in range(4000)]
    probes = [("hot", 40 * day + (rng.choice([0, 1, -1, rng.randrange(day)])), i) for i in range(60)]
    probes += [(rng.choice(["a", "hot", None]), rng.randrange(950) * day, 60 + i) for i in range(60)]
    fd = spark.createDataFrame(facts, "k string, ft long, fid long, v double")
    pd_ = spark.createDataFrame(probes, "k string, pt long, pid long")
    cuts = A.burst_cuts(fd, ["k"], time="ft", order=["fid"], rows=100)
    placed = A._cut(fd.select("k", F.col("ft").alias("_t"), F.col("fid").alias("_o0")), ["k"], A._width(A.CHUNK_DAYS), cuts, lambda c: c < F.struct("_t", "_o0"))
    sizes = [r["count"] for r in placed.groupBy("k", "_chunk").count().collect()]
    assert len(sizes) > 30 and max(sizes) < 400
    for strict in (True, False):
        kw = {"fact_time": "ft", "probe_time": "pt", "strict": strict}
        for op in (lambda c: A.asof_last(fd, pd_, ["k"], order=["fid"], values=["fid", "v"], cuts=c, **kw),
                   lambda c: A.asof_rolling(fd, pd_, ["k"], order=["fid"], window=7, measures=["v"], aggs={"s": F.sum("v")}, cuts=c, **kw),
                   lambda c: A.asof_cumulative(fd, pd_, ["k"], sums={"s": F.col("v")}, maxima={"m": F.col("fid")}, cuts=c, order=["fid"], **kw)):
            assert sorted(map(str, op(cuts).collect())) == sorted(map(str, op(None).collect()))


def test_latest_quotes_stay_in_arrow_between_batches(spark):
    """Books keep their quotes over batches of three rows, and no quote becomes a Python object."""
    from knowntime.operators import quotes as Q
    t0 = dt.datetime(2024, 1, 1)
    at = lambda m: t0 + dt.timedelta(minutes=m)
    rng = random.Random(11)
    rows = [(i, i % 2, f"b{rng.randrange(3)}", at(rng.randrange(600)), rng.randrange(30), 1.5 + i, None if i % 5 == 0 else 2.0) for i in range(120)]
    rows = [(i, c, b, t, t + dt.timedelta(minutes=lag), h, a) for i, c, b, t, lag, h, a in rows]
    asked = [(c, at(m)) for c in (0, 1) for m in range(0, 700, 9)]
    q = spark.createDataFrame(rows, "quote_id long, contest_id long, book string, quote_at timestamp_ntz, available_at timestamp_ntz, "
                              "home_odds double, away_odds double").coalesce(1)
    d = spark.createDataFrame(asked, "contest_id long, decision_at timestamp_ntz")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = {(x.contest_id, x.decision_at, x.book): (x.quote_id, x.home_odds, x.away_odds)
               for x in Q.latest_quotes(q, d, max_age_us=90 * 60_000_000).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for c, t in asked:
        for r in sorted((r for r in rows if r[1] == c and max(r[3], r[4]) <= t <= r[3] + dt.timedelta(minutes=90)), key=lambda r: (r[4], r[3], r[0])):
            want[c, t, r[2]] = (r[0], r[5], r[6])
    assert got == want and len(want) > 200


def test_residual_boosting_sweeps_quotes_once(spark, sf):
    """Its inputs need the reference books alone, and equal those of the whole market table."""
    from knowntime.catalog.market import consensus_rows, market_rows
    rows = consensus_rows(spark, sf)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    names = ["contest_id", "decision_at", "q", "past", "dispersion", "age_minutes", "mean_overround"]
    assert sorted(map(str, rows.select(names).collect())) == sorted(map(str, market_rows(spark, sf).select(names).collect()))


def test_expected_starter_by_plain_search_looks_up_instants_once(spark, monkeypatch):
    """Many contests share an instant; ties, unknown teams and times. As-of passes get each (key, instant) once."""
    from collections import Counter
    from knowntime.operators import starter as P
    rng = random.Random(21)
    t0 = dt.datetime(2023, 12, 20)
    at = lambda d: None if d is None else t0 + dt.timedelta(days=d)
    starts = [(i, rng.choice([1, 2, 2, 2, None]), at(rng.choice([None, *range(0, 90, 9)])), i % 2, rng.choice([7, 8, 9, None]),
               rng.choice([None, round(rng.uniform(-2, 2), 3)])) for i in range(400)]
    asked = [(i, rng.choice(["home", "away"]), rng.choice([1, 2, 3, None]), at(rng.choice([None, *range(-5, 100, 15)]))) for i in range(300)]
    sizes = []
    for name in ("asof_cumulative", "asof_rolling"):
        def seen(facts, probes, *a, _do=getattr(P, name), **k):
            sizes.append(probes.count())
            return _do(facts, probes, *a, **k)
        monkeypatch.setattr(P, name, seen)
    out = P.expected_starter(
        spark.createDataFrame(starts, "contest_id long, team long, available_at timestamp_ntz, seq int, starter long, epa double"),
        spark.createDataFrame(asked, "contest_id long, side string, team long, decision_at timestamp_ntz"), window=5).collect()
    assert len(out) == len(asked)
    got = {r.contest_id: (r.epa, r.starts, r.unknown, r.backup) for r in out}
    known = sorted((s for s in starts if s[2] and s[4]), key=lambda s: (s[2], s[0], s[3]))
    for c, _, team, when in asked:
        past = [s for s in known if when and s[2] < when]
        own = [s for s in past if s[1] == team and team]
        want = (0.0, 0.0, 1.0, 0.0)
        if own:
            expected, uses = own[-1][4], Counter(s[4] for s in own)
            most = max(uses, key=lambda p: (uses[p], -next(i for i, s in enumerate(own) if s[4] == p)))
            every = [s for s in past if s[4] == expected]
            epa = [s[5] for s in every if s[5] is not None][-5:]
            if epa:
                want = (pytest.approx(sum(epa) / len(epa)), float(len(every)), 0.0, float(expected != most))
        assert got[c] == want, c
    assert max(sizes) <= 3 * 8
