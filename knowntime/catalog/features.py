"""Registered queries: rolling form, rest, ratings and box features."""

from __future__ import annotations

from pyspark.sql import functions as F

from knowntime import views as V
from knowntime.catalog.registry import query
from knowntime.operators import form, ratings

PROBE = ["contest_id", "league", "team", "side", "scheduled_at", "decision_at"]


def r6(name, column=None):
    return F.round(F.col(name) if column is None else column, 6).alias(name)


FORM_SQL = """, ranked AS (
  SELECT p.contest_id, p.side, f.scored - f.allowed AS margin, f.scored, f.allowed, f.win,
         row_number() OVER (PARTITION BY p.contest_id, p.side
                            ORDER BY f.available_at DESC, f.contest_id DESC) AS rn
  FROM sides p JOIN sides f ON f.league = p.league AND f.team = p.team
       AND f.available_at < p.decision_at),
form AS (
  SELECT p.contest_id, p.side, coalesce(avg(margin), 0) AS margin, coalesce(avg(r.scored), 0) AS scored,
         coalesce(avg(r.allowed), 0) AS allowed, coalesce(avg(r.win), 0.5) AS win, count(r.rn) AS n
  FROM sides p LEFT JOIN ranked r ON r.contest_id = p.contest_id AND r.side = p.side AND r.rn <= {n}
  GROUP BY p.contest_id, p.side),
starts AS (
  SELECT p.contest_id, p.side, max(f.scheduled_at) AS last_start
  FROM sides p LEFT JOIN sides f ON f.league = p.league AND f.team = p.team
       AND f.scheduled_at < p.decision_at GROUP BY ALL),
rest AS (
  SELECT p.contest_id, p.side, CASE WHEN last_start IS NULL THEN {cap}::DOUBLE ELSE
         least({cap}::DOUBLE, (epoch_us(p.scheduled_at) - epoch_us(last_start)) / 86400000000.0::DOUBLE)
         END AS rest
  FROM sides p JOIN starts s USING (contest_id, side))"""

FORM_SELECT = """
SELECT h.contest_id, round(h.margin - a.margin, 6) AS margin_diff,
       round(h.scored - a.scored, 6) AS scored_diff, round(h.allowed - a.allowed, 6) AS allowed_diff,
       round(h.win - a.win, 6) AS win_rate_diff, CAST(h.n - a.n AS BIGINT) AS history_count_diff,
       round(rh.rest, 6) AS home_rest, round(ra.rest, 6) AS away_rest,
       CAST(rh.rest < 1.5 AS DOUBLE) AS home_b2b, CAST(ra.rest < 1.5 AS DOUBLE) AS away_b2b
FROM form h JOIN form a ON a.contest_id = h.contest_id AND a.side = 'away'
     JOIN rest rh ON rh.contest_id = h.contest_id AND rh.side = 'home'
     JOIN rest ra ON ra.contest_id = h.contest_id AND ra.side = 'away'
WHERE h.side = 'home'"""


def form_rows(contests, window, cap, pool=("league",), probed=None):
    """Rolling form and rest per contest, home minus away.

    ``probed`` are the contests to describe (default: the facts themselves); contests that are
    not facts never enter a history.
    """
    s, keys = V.sides(contests if probed is None else probed), [*pool, "team"]
    facts = V.sides(contests).select(*keys, "available_at", "scheduled_at", "contest_id", "scored", "allowed", "win")
    probes = s.select(*pool, "contest_id", "team", "side", "scheduled_at", "decision_at")
    p = form.rolling_form(facts, probes, window=window, keys=keys)
    p = form.rest_days(facts, p, cap=cap, keys=keys)
    ids = [*[k for k in pool if k != "league"], "contest_id"]
    return _differences(form.home_minus_away(p, ids, {
        n: F.col(n) for n in ("form_margin", "form_scored", "form_allowed", "form_win", "form_n",
                              "rest", "b2b")}), ids)


def _differences(wide, ids, *more):
    """Form as home minus away, rest of each side, from the ``<name>_home`` and ``<name>_away`` of a contest."""
    diff = lambda n: F.col(f"form_{n}_home") - F.col(f"form_{n}_away")
    return wide.select(
        *ids, diff("margin").alias("margin_diff"), diff("scored").alias("scored_diff"),
        diff("allowed").alias("allowed_diff"), diff("win").alias("win_rate_diff"),
        diff("n").cast("bigint").alias("history_count_diff"), F.col("rest_home").alias("home_rest"),
        F.col("rest_away").alias("away_rest"), F.col("b2b_home").alias("home_b2b"),
        F.col("b2b_away").alias("away_b2b"), *more)


def form_table(spark, sf_dir, window, cap):
    return form_rows(V.contests(spark, sf_dir), window, cap)


def model_rows(contests, *, window=20, cap=14, advantage=65, pool=("league",), probed=None):
    """The assembled inputs of every contest with its label."""
    ids = [*[k for k in pool if k != "league"], "contest_id"]
    base = (contests if probed is None else probed).select(*ids, "league", "season", "scheduled_at", "decision_at", "available_at", "neutral",
                           (F.col("home_score") > F.col("away_score")).cast("int").alias("y"),
                           (F.col("home_score") == F.col("away_score")).cast("int").alias("is_tie"))
    # The fold carries the scores, so a result and the ratings after it are one fact of its two teams.
    keys, seen = [*pool, "team"], contests if probed is None else probed
    rated = ratings.rating_fold(ratings.with_outcome(contests), list(pool), advantage=advantage, carry=["home_score", "away_score"])
    of = lambda a, b: F.struct(F.col(f"{a}_id").alias("team"), F.col(f"{a}_score").alias("scored"),
                               F.col(f"{b}_score").alias("allowed"), F.col(f"{a}_rating").alias("rating"))
    facts = rated.withColumn("_s", F.explode(F.array(of("home", "away"), of("away", "home")))).select(*pool, "available_at", "contest_id", "_s.*")
    sides = V.sides(seen).select(*keys, "contest_id", "side", "scheduled_at", "decision_at")
    past = form.side_history(facts, V.sides(contests).select(*keys, "scheduled_at"), sides, window=window, cap=cap, initial=ratings.INITIAL,
                             keys=keys, ids=ids)
    lead = F.col("rating_home") - F.col("rating_away")
    return base.join(_differences(past, ids, lead.alias("elo_diff")), ids).withColumn(
        "p_elo", ratings.win_probability(F.col("elo_diff"), F.lit(float(advantage)) * (1 - F.col("neutral"))))


def probe_rows(settled, schedule, **kw):
    """Inputs for a whole schedule from settled contests only (unplayed ones are probes)."""
    return model_rows(settled, probed=schedule, **kw)


def _rounded(frame):
    return frame.select("contest_id", *[r6(c) for c in ("margin_diff", "scored_diff", "allowed_diff",
                                                        "win_rate_diff")],
                        "history_count_diff", r6("home_rest"), r6("away_rest"), "home_b2b", "away_b2b")


@query("rolling_form_20", "WITH " + V.SIDES + FORM_SQL.format(n=20, cap=14) + FORM_SELECT)
def rolling_form_20(spark, sf_dir):
    """Last-20 form and rest, home minus away."""
    return _rounded(form_table(spark, sf_dir, 20, 14))


@query("rolling_form_10_ties", "WITH " + V.SIDES + FORM_SQL.format(n=10, cap=21) + FORM_SELECT)
def rolling_form_10_ties(spark, sf_dir):
    """Last-10 form where ties count a half, rest cap 21."""
    return _rounded(form_table(spark, sf_dir, 10, 21))


SCHEDULED_SQL = """, ranked AS (
  SELECT p.contest_id, p.side, f.scored - f.allowed AS margin, f.scored, f.allowed, f.scheduled_at AS start,
         row_number() OVER (PARTITION BY p.contest_id, p.side
                            ORDER BY f.scheduled_at DESC, f.contest_id DESC) AS rn
  FROM late p JOIN late f ON f.league = p.league AND f.team = p.team
       AND f.available_at < p.decision_at)
SELECT p.contest_id, p.side, CAST(count(rn) AS BIGINT) AS form_n,
       round(coalesce(avg(margin), 0), 6) AS form_margin, round(coalesce(avg(r.scored), 0), 6) AS form_scored,
       round(coalesce(avg(r.allowed), 0), 6) AS form_allowed,
       round(coalesce(avg(CASE WHEN margin > 0 THEN 1.0 WHEN margin <= 0 THEN 0.0 END::DOUBLE), 0.5), 6) AS form_win,
       round(coalesce(least(14.0::DOUBLE, (epoch_us(p.scheduled_at) - epoch_us(max(start))) / 86400000000.0::DOUBLE), 14), 6) AS rest,
       count(rn) >= 5 AS enough_history
FROM late p LEFT JOIN ranked r ON r.contest_id = p.contest_id AND r.side = p.side AND r.rn <= 10
GROUP BY p.contest_id, p.side, p.scheduled_at"""


@query("scheduled_order_form", "WITH " + V.SIDES + """, late AS (
  SELECT * REPLACE (available_at + to_hours(CAST(CASE WHEN contest_id % 23 = 0 THEN -1500 WHEN contest_id % 19 = 0 THEN 9000
                    ELSE contest_id % 5 * 60 END AS INTEGER)) AS available_at) FROM sides)"""
       + SCHEDULED_SQL)
def scheduled_order_form(spark, sf_dir):
    """Last-10 visible contests in schedule order (D3): results out of order, some known two months before
    their start, some withheld for a year."""
    s = V.sides(V.contests(spark, sf_dir))
    k = F.col("contest_id")
    hours = F.when(k % 23 == 0, -1500).when(k % 19 == 0, 9000).otherwise(k % 5 * 60)
    late = s.withColumn("available_at", F.col("available_at") + F.make_dt_interval(F.lit(0), hours.cast("int")))
    facts = late.select("league", "team", "available_at", "scheduled_at", "contest_id", "scored",
                        "allowed", "win")
    out = form.scheduled_form(facts, late.select(*PROBE), window=10, min_history=5, cap=14)
    return out.select("contest_id", "side", "form_n",
                      *[r6(c) for c in ("form_margin", "form_scored", "form_allowed", "form_win",
                                        "rest")], "enough_history")


FOLD_SQL = """, revealed AS (
  SELECT *, CASE WHEN home_score > away_score THEN 1.0 WHEN home_score < away_score THEN 0.0
            ELSE 0.5 END::DOUBLE AS outcome FROM {source}),
seq AS (
  SELECT scenario, league, contest_id, home_id, away_id, outcome, neutral, available_at,
         row_number() OVER (PARTITION BY scenario, league ORDER BY available_at, contest_id) AS step
  FROM revealed),
fold AS (
  SELECT scenario, league, 0::BIGINT AS step, NULL::BIGINT AS contest_id, NULL::BIGINT AS home_id, NULL::BIGINT AS away_id,
         NULL::TIMESTAMP AS available_at, list_transform(range(30), lambda x: 1500.0::DOUBLE) AS r
  FROM (SELECT DISTINCT scenario, league FROM seq)
  UNION ALL
  SELECT s.scenario, s.league, s.step, s.contest_id, s.home_id, s.away_id, s.available_at,
         list_transform(f.r, lambda v, i: CASE WHEN i = s.home_id + 1 THEN v + d.delta
                                            WHEN i = s.away_id + 1 THEN v - d.delta ELSE v END)
  FROM fold f JOIN seq s ON s.scenario = f.scenario AND s.league = f.league AND s.step = f.step + 1,
       LATERAL (SELECT 20.0::DOUBLE * (s.outcome - 1.0::DOUBLE / (1.0::DOUBLE + pow(10.0::DOUBLE,
         -(f.r[s.home_id + 1] - f.r[s.away_id + 1] + {adv}::DOUBLE * (1 - s.neutral)) / 400.0::DOUBLE))) AS delta) d),"""
ELO_SQL = FOLD_SQL + """
moves AS (
  SELECT scenario, league, u.team, available_at, arg_max(u.rating, contest_id) AS rating FROM (
    SELECT scenario, league, contest_id, available_at,
           unnest([struct_pack(team := home_id, rating := r[home_id + 1]), struct_pack(team := away_id, rating := r[away_id + 1])]) AS u
    FROM fold WHERE step > 0) GROUP BY ALL),
asked AS (
  SELECT scenario, contest_id, league, decision_at, u.side, u.team FROM (
    SELECT *, unnest([struct_pack(side := 'home', team := home_id), struct_pack(side := 'away', team := away_id)]) AS u FROM revealed)),
seen AS (
  SELECT p.scenario, p.contest_id, p.side, m.rating
  FROM asked p ASOF LEFT JOIN moves m ON m.scenario = p.scenario AND m.league = p.league AND m.team = p.team
       AND p.decision_at > m.available_at)
SELECT h.scenario, h.contest_id,
       round(coalesce(h.rating, 1500) - coalesce(a.rating, 1500), 6) AS elo_diff,
       round(1 / (1 + pow(10.0::DOUBLE, -(coalesce(h.rating, 1500) - coalesce(a.rating, 1500)
             + {adv}::DOUBLE * (1 - c.neutral)) / 400.0::DOUBLE)), 6) AS p_elo
FROM seen h JOIN seen a ON a.scenario = h.scenario AND a.contest_id = h.contest_id AND a.side = 'away'
     JOIN revealed c ON c.scenario = h.scenario AND c.contest_id = h.contest_id
WHERE h.side = 'home'"""


def elo_table(contests, pool, *, advantage, probed=None):
    """Rating difference and win probability per contest as of its decision."""
    results = ratings.with_outcome(contests)
    rated = ratings.rating_fold(results, pool, advantage=advantage)
    probes = V.sides(contests if probed is None else probed).select(
        *pool, "contest_id", "team", "side", "decision_at", "neutral")
    p = ratings.rating_probes(rated, probes, pool)
    keys = [k for k in pool if k != "league"] + ["contest_id", "neutral"]
    wide = form.home_minus_away(p, keys, {"rating": F.col("rating")})
    diff = F.col("rating_home") - F.col("rating_away")
    return wide.withColumn("elo_diff", diff).withColumn(
        "p_elo", ratings.win_probability(diff, F.lit(float(advantage)) * (1 - F.col("neutral"))))


@query("rating_fold", "WITH RECURSIVE " + V.CONTESTS + """, base AS (SELECT 0 AS scenario, * FROM contests
  WHERE home_score <> away_score)""" + ELO_SQL.format(source="base", adv=65).replace(
      "h.scenario, h.contest_id,", "h.contest_id,"))
def rating_fold(spark, sf_dir):
    """Rating fold without ties, home advantage 65."""
    c = V.contests(spark, sf_dir).where("home_score <> away_score")
    return elo_table(c, ["league"], advantage=65).select("contest_id", r6("elo_diff"), r6("p_elo"))


AFTER_SQL = "WITH RECURSIVE " + V.CONTESTS + ", base AS (SELECT 0 AS scenario, * FROM contests WHERE home_score <> away_score)" + FOLD_SQL.format(
    source="base", adv=65).rstrip().rstrip(",") + """
SELECT league, contest_id, round(r[home_id + 1], 6) AS home_rating, round(r[away_id + 1], 6) AS away_rating FROM fold WHERE step > 0"""


@query("rating_after_result", AFTER_SQL)
def rating_after_result(spark, sf_dir):
    """Both ratings after every result."""
    c = ratings.with_outcome(V.contests(spark, sf_dir).where("home_score <> away_score"))
    return ratings.rating_fold(c, ["league"]).select("league", "contest_id", r6("home_rating"), r6("away_rating"))


@query("rating_fold_ties", "WITH RECURSIVE " + V.CONTESTS + ", base AS (SELECT 0 AS scenario, * FROM contests)"
       + ELO_SQL.format(source="base", adv=55).replace("h.scenario, h.contest_id,", "h.contest_id,"))
def rating_fold_ties(spark, sf_dir):
    """Rating fold with ties at one half, home advantage 55."""
    return elo_table(V.contests(spark, sf_dir), ["league"], advantage=55).select(
        "contest_id", r6("elo_diff"), r6("p_elo"))


@query("delay_scenarios", "WITH RECURSIVE " + V.CONTESTS + """, base AS (
  SELECT d.scenario, c.* REPLACE (available_at + to_hours(d.scenario) AS available_at)
  FROM contests c, (VALUES (0), (24), (48)) d(scenario) WHERE home_score <> away_score)"""
       + ELO_SQL.format(source="base", adv=65))
def delay_scenarios(spark, sf_dir):
    """The whole rating pipeline rebuilt under extra result delays of 0, 24 and 48 hours."""
    c = V.contests(spark, sf_dir).where("home_score <> away_score")
    return elo_table(delayed(c, (0, 24, 48)), ["scenario", "league"], advantage=65).select(
        "scenario", "contest_id", r6("elo_diff"), r6("p_elo"))


def delayed(contests, hours):
    """One copy of the contests per extra delay; the scenario becomes part of every key."""
    return (contests.withColumn("scenario", F.explode(F.array(*[F.lit(h) for h in hours])))
            .withColumn("available_at", F.col("available_at")
                        + F.make_dt_interval(F.lit(0), F.col("scenario"))))


BOX_SQL = """, lines AS (
  SELECT s.*, CAST(s.scored AS DOUBLE) AS pts, b.fga, b.fgm, b.fg3m, b.fta, b.oreb, b.tov,
         b.fga - b.oreb + b.tov + 0.44::DOUBLE * b.fta AS poss
  FROM sides s JOIN box b ON b.contest_id = s.contest_id AND b.side = s.side),
paired AS (
  SELECT m.*, o.pts AS opp_pts, o.poss AS opp_poss
  FROM lines m JOIN lines o ON o.contest_id = m.contest_id AND o.side <> m.side),
ranked AS (
  SELECT p.contest_id AS pid, p.side AS pside, f.*, row_number() OVER (
           PARTITION BY p.contest_id, p.side ORDER BY f.available_at DESC, f.contest_id DESC) AS rn
  FROM sides p JOIN paired f ON f.league = p.league AND f.team = p.team AND f.available_at < p.decision_at),
tot AS (
  SELECT pid, pside, count(*) AS n, sum(pts) pts, greatest(sum(poss), 1) poss, sum(opp_pts) opp_pts,
         greatest(sum(opp_poss), 1) opp_poss, greatest(sum(fga), 1) fga, sum(fgm) fgm, sum(fg3m) fg3m,
         sum(fta) fta, sum(oreb) oreb, sum(tov) tov, greatest(sum(fga) - sum(fgm), 1) misses
  FROM ranked WHERE rn <= 20 GROUP BY ALL),
rates AS (
  SELECT p.contest_id, p.side, coalesce(100 * pts / poss, 0) AS o, coalesce(100 * opp_pts / opp_poss, 0) AS d,
         coalesce(poss / n, 0) AS pace, coalesce((fgm + 0.5 * fg3m) / fga, 0) AS efg, coalesce(tov / poss, 0) AS tv,
         coalesce(oreb / misses, 0) AS ob, coalesce(fta / fga, 0) AS ft
  FROM sides p LEFT JOIN tot t ON t.pid = p.contest_id AND t.pside = p.side)
SELECT h.contest_id, round(h.o - a.o, 6) + 0.0::DOUBLE AS off_rating_diff, round(h.d - a.d, 6) + 0.0::DOUBLE AS def_rating_diff,
       round((h.o - h.d) - (a.o - a.d), 6) + 0.0::DOUBLE AS net_rating_diff, round(h.pace - a.pace, 6) + 0.0::DOUBLE AS pace_diff,
       round(h.efg - a.efg, 6) + 0.0::DOUBLE AS efg_diff, round(h.tv - a.tv, 6) + 0.0::DOUBLE AS tov_rate_diff,
       round(h.ob - a.ob, 6) + 0.0::DOUBLE AS oreb_rate_diff, round(h.ft - a.ft, 6) + 0.0::DOUBLE AS ft_rate_diff
FROM rates h JOIN rates a ON a.contest_id = h.contest_id AND a.side = 'away' WHERE h.side = 'home'"""


def box_table(spark, sf_dir):
    s = V.sides(V.contests(spark, sf_dir))
    lines = s.select("contest_id", "side", "league", "team", "available_at",
                     F.col("scored").cast("double").alias("pts")).join(
        V.box_lines(spark, sf_dir).na.drop(subset=list(form.BOX_MEASURES)), ["contest_id", "side"])
    p = form.box_form(form.paired_box(lines), s.select(*PROBE), window=20)
    names = ("off_rating", "def_rating", "net_rating", "pace", "efg", "tov_rate", "oreb_rate", "ft_rate")
    wide = form.home_minus_away(p, ["contest_id"], {n: F.col(n) for n in names})
    return wide.select("contest_id", *[(F.col(f"{n}_home") - F.col(f"{n}_away")).alias(f"{n}_diff")
                                       for n in names])


@query("box_ratio_form", "WITH " + V.SIDES + ", " + V.BOX + BOX_SQL)
def box_ratio_form(spark, sf_dir):
    """Rolling ratios of sums from paired box lines."""
    t = box_table(spark, sf_dir)
    return t.select("contest_id", *[r6(c) for c in t.columns if c != "contest_id"])


@query("previous_season_rate", "WITH " + V.SIDES + """
SELECT p.contest_id, p.side, round(coalesce(avg(CAST(f.win = 1.0 AS INTEGER)), 0.5), 6) AS prev_win_rate
FROM sides p LEFT JOIN sides f ON f.league = p.league AND f.team = p.team AND f.season = p.season - 1
     AND f.available_at < p.decision_at GROUP BY ALL""")
def previous_season_rate(spark, sf_dir):
    """Win rate over last season's visible results."""
    s = V.sides(V.contests(spark, sf_dir))
    out = form.previous_season_rate(s.select("league", "team", "season", "available_at", "win"),
                                    s.select(*PROBE, "season"))
    return out.select("contest_id", "side", r6("prev_win_rate"))


POSSESSION_SQL = "WITH " + V.BOX + """
SELECT contest_id, side, round(fga - oreb + tov + 0.44::DOUBLE * fta, 6) AS poss FROM box"""


@query("possession_estimate", POSSESSION_SQL)
def possession_estimate(spark, sf_dir):
    """Possessions per contest and side."""
    return V.box_lines(spark, sf_dir).select("contest_id", "side", r6("poss", form.possessions()))


DECIDED_SIDES = V.SIDES.replace("contests AS (", "every_contest AS (", 1).replace(
    ", sides AS (", ", contests AS (SELECT * FROM every_contest WHERE home_score <> away_score), sides AS (", 1)
ELO_CTES, ELO_FINAL = ELO_SQL.rsplit("\nSELECT h.scenario", 1)
ASSEMBLED_SQL = ("WITH RECURSIVE " + DECIDED_SIDES + FORM_SQL.format(n=20, cap=14) + ", base AS (SELECT 0 AS scenario, * FROM contests)"
                 + ELO_CTES.format(source="base", adv=65) + ", elo AS (SELECT h.scenario" + ELO_FINAL.format(adv=65) + "), shape AS ("
                 + FORM_SELECT + """)
SELECT s.*, e.elo_diff, e.p_elo, c.neutral, CAST(c.home_score > c.away_score AS INTEGER) AS y
FROM shape s JOIN elo e USING (contest_id) JOIN contests c USING (contest_id)""")


@query("assembled_features", ASSEMBLED_SQL)
def assembled_features(spark, sf_dir):
    """All eleven base inputs, the rating probability and the label."""
    t = model_rows(V.contests(spark, sf_dir).where("home_score <> away_score"))
    return t.select("contest_id", *[r6(c) for c in ("margin_diff", "scored_diff", "allowed_diff", "win_rate_diff", "home_rest",
                                                    "away_rest", "elo_diff", "p_elo")],
                    "history_count_diff", "home_b2b", "away_b2b", "neutral", "y")


NOW = "2001-01-01 00:00:00"
PENDING_SQL = ("WITH " + V.SIDES + f""", fsides AS (SELECT * FROM sides WHERE available_at < TIMESTAMP '{NOW}'),
psides AS (SELECT * REPLACE (least(decision_at, TIMESTAMP '{NOW}') AS decision_at) FROM sides WHERE scheduled_at >= TIMESTAMP '{NOW}')"""
               + FORM_SQL.format(n=20, cap=14).replace("sides p", "psides p").replace("sides f", "fsides f") + FORM_SELECT)


@query("pending_probe_features", PENDING_SQL)
def pending_probe_features(spark, sf_dir):
    """Inputs of unplayed contests: probes that are never facts."""
    now = F.lit(NOW).cast("timestamp_ntz")
    c = V.contests(spark, sf_dir)
    probed = c.where(F.col("scheduled_at") >= now).withColumn("decision_at", F.least("decision_at", now))
    return _rounded(form_rows(c.where(F.col("available_at") < now), 20, 14, probed=probed))
