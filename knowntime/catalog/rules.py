"""Registered queries: parsing, constraint suites, labels, exclusions and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from knowntime import views as V
from knowntime.catalog.features import r6
from knowntime.catalog.registry import query
from knowntime.functions import times as T
from knowntime.operators import quality as Q, splits as S


def game():
    return F.col("game_id")


def raw_games(spark, sf_dir):
    """Contests with planted faults, so that every rule has something to find."""
    c = V.contests(spark, sf_dir).withColumnRenamed("contest_id", "game_id")
    every = lambda n, r=0: game() % n == r
    return (c.withColumn("home_id", F.when(every(601), F.col("away_id")).otherwise(F.col("home_id")))
            .withColumn("observed_at", F.when(every(701), F.col("scheduled_at")).otherwise(F.col("observed_at")))
            .withColumn("decision_at", F.when(every(811), F.col("scheduled_at")).otherwise(F.col("decision_at")))
            .withColumn("away_id", F.when(every(907), None).otherwise(F.col("away_id")))
            .withColumn("available_at", F.when(every(503), F.col("scheduled_at")).otherwise(F.col("available_at")))
            .withColumn("home_score", F.when(every(401), -1.0).when(every(409), 80.5)
                        .otherwise(F.col("home_score").cast("double")))
            .withColumn("season_type", F.when(every(331), "post").otherwise("regular"))
            .withColumn("is_neutral", F.when(every(443), "maybe").when(every(2), "TRUE").when(every(3), "0").otherwise("False"))
            .withColumn("source_status", F.when(every(257), "Q4 1:00").otherwise(" Final/OT"))
            .withColumn("contract", F.when(every(373), "other").otherwise("regular_tie_push")))


RAW = V.CONTESTS + """, raw AS (
  SELECT contest_id AS game_id, league, season, scheduled_at, neutral,
         CASE WHEN contest_id % 601 = 0 THEN away_id ELSE home_id END AS home_id,
         CASE WHEN contest_id % 907 = 0 THEN NULL ELSE away_id END AS away_id,
         CASE WHEN contest_id % 701 = 0 THEN scheduled_at ELSE observed_at END AS observed_at,
         CASE WHEN contest_id % 811 = 0 THEN scheduled_at ELSE decision_at END AS decision_at,
         CASE WHEN contest_id % 503 = 0 THEN scheduled_at ELSE available_at END AS available_at,
         CASE WHEN contest_id % 401 = 0 THEN -1.0::DOUBLE WHEN contest_id % 409 = 0 THEN 80.5::DOUBLE ELSE home_score::DOUBLE END AS home_score,
         away_score,
         CASE WHEN contest_id % 331 = 0 THEN 'post' ELSE 'regular' END AS season_type,
         CASE WHEN contest_id % 443 = 0 THEN 'maybe' WHEN contest_id % 2 = 0 THEN 'TRUE' WHEN contest_id % 3 = 0 THEN '0' ELSE 'False' END AS is_neutral,
         CASE WHEN contest_id % 257 = 0 THEN 'Q4 1:00' ELSE ' Final/OT' END AS source_status,
         CASE WHEN contest_id % 373 = 0 THEN 'other' ELSE 'regular_tie_push' END AS contract
  FROM contests),
games AS (SELECT * FROM raw WHERE game_id % 211 <> 0 UNION ALL SELECT * FROM raw WHERE game_id % 1009 = 0),
results AS (SELECT game_id, home_score, away_score, available_at FROM raw WHERE game_id % 223 <> 0
            UNION ALL SELECT game_id, home_score, away_score, available_at FROM raw WHERE game_id % 2003 = 0),
odds AS (
  SELECT user_id AS game_id, event_type AS book, ts AS quote_at,
         ts + to_minutes(CAST(event_id % 7 - CASE WHEN event_id % 307 = 0 THEN 10 ELSE 0 END AS INTEGER)) AS available_at,
         CASE WHEN event_id % 101 = 0 THEN 1.0::DOUBLE WHEN event_id % 103 = 0 THEN 'nan'::DOUBLE ELSE 1.05::DOUBLE + value / 100 END AS home_odds,
         1.05::DOUBLE + (500 - least(value, 499.0::DOUBLE)) / 100 AS away_odds FROM events
  UNION ALL
  SELECT user_id, event_type, ts, ts + to_minutes(CAST(event_id % 7 AS INTEGER)), 2.0, 2.0 FROM events WHERE event_id % 701 = 0)"""


def faulty(spark, sf_dir):
    raw = raw_games(spark, sf_dir)
    games = raw.where(game() % 211 != 0).unionByName(raw.where(game() % 1009 == 0))
    cols = ["game_id", "home_score", "away_score", "available_at"]
    results = raw.where(game() % 223 != 0).select(*cols).unionByName(raw.where(game() % 2003 == 0).select(*cols))
    return games, results


def faulty_odds(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    k = F.col("event_id")
    lag = k % 7 - F.when(k % 307 == 0, 10).otherwise(0)
    q = e.select(F.col("user_id").alias("game_id"), F.col("event_type").alias("book"), F.col("ts").alias("quote_at"),
                 (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), lag.cast("int"))).alias("available_at"),
                 F.when(k % 101 == 0, 1.0).when(k % 103 == 0, float("nan")).otherwise(1.05 + F.col("value") / 100).alias("home_odds"),
                 (1.05 + (500 - F.least("value", F.lit(499.0))) / 100).alias("away_odds"))
    again = e.where(k % 701 == 0).select(
        F.col("user_id").alias("game_id"), F.col("event_type").alias("book"), F.col("ts").alias("quote_at"),
        (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), (k % 7).cast("int"))).alias("available_at"),
        F.lit(2.0).alias("home_odds"), F.lit(2.0).alias("away_odds"))
    return q.unionByName(again)


def _rule(name, sql):
    return f"SELECT '{name}' AS rule, CAST(({sql}) AS BIGINT) AS violations"


DUP = "SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM {t} GROUP BY {k})"
COUNT = "SELECT count(*) FROM {t} WHERE {c}"
SCORE_BAD = ("home_score IS NULL OR isnan(home_score) OR home_score < 0 OR home_score <> floor(home_score) "
             "OR away_score IS NULL OR away_score < 0")

MARKET_RULES = [
    ("games_null_field", COUNT.format(t="games", c="home_id IS NULL OR away_id IS NULL")),
    ("identical_teams", COUNT.format(t="games", c="home_id = away_id")),
    ("schedule_after_decision", COUNT.format(t="games", c="observed_at > decision_at")),
    ("cutoff_differs", COUNT.format(t="games", c="epoch_us(scheduled_at) - epoch_us(decision_at) <> 3600000000")),
    ("duplicate_game", DUP.format(t="games", k="game_id")),
    ("results_null_field", COUNT.format(t="results", c="home_score IS NULL")),
    ("invalid_score", COUNT.format(t="results", c=SCORE_BAD)),
    ("tied_score", COUNT.format(t="results", c="home_score = away_score")),
    ("duplicate_result", DUP.format(t="results", k="game_id")),
    ("unmapped_result", "SELECT count(*) FROM results WHERE game_id NOT IN (SELECT game_id FROM games)"),
    ("result_before_start", "SELECT count(*) FROM results r JOIN (SELECT DISTINCT game_id, scheduled_at FROM games) g USING (game_id) WHERE r.available_at <= g.scheduled_at"),
    ("odds_null_field", COUNT.format(t="odds", c="home_odds IS NULL")),
    ("invalid_price", COUNT.format(t="odds", c="isnan(home_odds) OR home_odds <= 1 OR away_odds <= 1")),
    ("quote_after_available", COUNT.format(t="odds", c="quote_at > available_at")),
    ("duplicate_revision", DUP.format(t="odds", k="game_id, book, quote_at, available_at")),
    ("unmapped_quote", "SELECT count(*) FROM odds WHERE game_id NOT IN (SELECT game_id FROM games)")]

JOINED = "(SELECT g.*, r.home_score AS hs, r.away_score AS aws, r.available_at AS av FROM games g JOIN results r USING (game_id))"
SEASON_RULES = [
    ("missing_time", COUNT.format(t=JOINED, c="scheduled_at IS NULL OR av IS NULL")),
    ("decision_not_before_start", COUNT.format(t=JOINED, c="decision_at >= scheduled_at")),
    ("result_not_after_start", COUNT.format(t=JOINED, c="av <= scheduled_at")),
    ("schedule_after_decision", COUNT.format(t=JOINED, c="observed_at > decision_at")),
    ("invalid_teams", COUNT.format(t=JOINED, c="home_id IS NULL OR away_id IS NULL OR home_id = away_id")),
    ("invalid_score", COUNT.format(t=JOINED, c="hs IS NULL OR hs < 0 OR hs <> floor(hs)")),
    ("not_regular", COUNT.format(t=JOINED, c="season_type <> 'regular'")),
    ("invalid_neutral_flag", COUNT.format(t=JOINED, c="is_neutral = 'maybe'"))]
ID_RULES = [("duplicate_game", DUP.format(t="games", k="game_id")),
            ("duplicate_result", DUP.format(t="results", k="game_id")),
            ("result_without_game", "SELECT count(*) FROM results WHERE game_id NOT IN (SELECT game_id FROM games)")]
BINARY_RULES = ID_RULES + [
    ("game_without_result", "SELECT count(*) FROM games WHERE game_id NOT IN (SELECT game_id FROM results)"),
    *SEASON_RULES, ("tied_score", COUNT.format(t=JOINED, c="hs = aws")),
    ("not_final", COUNT.format(t=JOINED, c="trim(source_status) NOT LIKE 'Final%'"))]
TIE_RULES = ID_RULES + SEASON_RULES + [("other_contract", COUNT.format(t=JOINED, c="contract <> 'regular_tie_push'"))]


def _suite_sql(rules):
    return "WITH " + RAW + " " + " UNION ALL ".join(_rule(*r) for r in rules)


@query("market_constraint_suite", _suite_sql(MARKET_RULES))
def market_constraint_suite(spark, sf_dir):
    """Violations per market-track rule."""
    games, results = faulty(spark, sf_dir)
    return Q.market_suite(games, results, faulty_odds(spark, sf_dir), cutoff_minutes=60)


def _season_tables(spark, sf_dir):
    games, results = faulty(spark, sf_dir)
    return games.drop("home_score", "away_score", "available_at"), results


@query("binary_constraint_suite", _suite_sql(BINARY_RULES))
def binary_constraint_suite(spark, sf_dir):
    """Violations per two-outcome rule."""
    return Q.binary_suite(*_season_tables(spark, sf_dir))


@query("tie_constraint_suite", _suite_sql(TIE_RULES))
def tie_constraint_suite(spark, sf_dir):
    """Violations per tie-aware rule."""
    return Q.tie_suite(*_season_tables(spark, sf_dir), "regular_tie_push")


@query("strict_timestamp_parse", """
WITH s AS (SELECT o_orderkey AS game_id, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS t, o_orderkey % 5 AS k FROM orders)
SELECT game_id, CASE WHEN k = 0 THEN t WHEN k = 1 THEN t + INTERVAL 5 HOUR WHEN k = 2 THEN t - INTERVAL 330 MINUTE END AS parsed FROM s""")
def strict_timestamp_parse(spark, sf_dir):
    """Explicit offsets only; date-only and naive values are rejected (B1)."""
    c = V.contests(spark, sf_dir)
    k, wall = F.col("contest_id") % 5, F.date_format("scheduled_at", "yyyy-MM-dd'T'HH:mm:ss")
    text = (F.when(k == 0, F.concat(wall, F.lit("Z"))).when(k == 1, F.concat(wall, F.lit("-05:00")))
            .when(k == 2, F.concat(wall, F.lit("+05:30"))).when(k == 3, wall)
            .otherwise(F.date_format("scheduled_at", "yyyy-MM-dd")))
    return c.select(F.col("contest_id").alias("game_id"), text.alias("_t")).select(
        "game_id", T.parse_strict("_t").cast("timestamp_ntz").alias("parsed"))


@query("tolerant_timestamp_parse", """
WITH s AS (SELECT o_orderkey AS game_id, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS t, o_orderkey % 6 AS k FROM orders),
p AS (SELECT game_id, CASE WHEN k = 2 THEN t + INTERVAL 5 HOUR WHEN k <> 5 THEN t END AS parsed FROM s)
SELECT game_id, parsed, strftime(parsed, '%Y-%m-%dT%H:%M:%S+00:00') AS canonical FROM p""")
def tolerant_timestamp_parse(spark, sf_dir):
    """Mixed spellings to one instant and one spelling (B2)."""
    c = V.contests(spark, sf_dir)
    k = F.col("contest_id") % 6
    wall, spaced = (F.date_format("scheduled_at", f) for f in ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss"))
    text = (F.when(k == 0, F.concat(wall, F.lit("+00:00"))).when(k == 1, F.concat(spaced, F.lit("+00:00")))
            .when(k == 2, F.concat(wall, F.lit("-05:00"))).when(k == 3, spaced)
            .when(k == 4, F.concat(wall, F.lit(".000000Z"))).otherwise("soon"))
    parsed = c.select(F.col("contest_id").alias("game_id"), text.alias("_t")).select(
        "game_id", T.parse_tolerant("_t").alias("_p"))
    return parsed.select("game_id", F.col("_p").cast("timestamp_ntz").alias("parsed"), T.canonical(F.col("_p")).alias("canonical"))


@query("label_derivation", "WITH " + RAW + """
SELECT game_id, CAST(home_score > away_score AS INTEGER) AS y, CAST(home_score = away_score AS INTEGER) AS is_tie,
       CASE WHEN home_score = away_score THEN 0.5 WHEN home_score > away_score THEN 1 ELSE 0 END::DOUBLE AS rating_score,
       CASE lower(is_neutral) WHEN 'true' THEN 1 WHEN '1' THEN 1 WHEN 'false' THEN 0 WHEN '0' THEN 0 END AS neutral,
       CAST(CASE WHEN game_id % 4 = 0 THEN 0 ELSE game_id % 2 END AS INTEGER) AS div_game FROM raw""")
def label_derivation(spark, sf_dir):
    """Outcome labels and flags."""
    raw = raw_games(spark, sf_dir).withColumn("div_game", F.when(game() % 4 != 0, game() % 2))
    return Q.labels(raw).select("game_id", "y", "is_tie", "rating_score", "neutral", "div_game")


SCHEDULE_SQL = """sched AS (
  SELECT lpad(CAST(2 * 10000000 + CASE WHEN o_orderkey % 13 = 0 THEN 10000000 ELSE 0 END + o_orderkey AS VARCHAR), 10, '0') AS game_id,
         CASE WHEN o_orderkey % 17 = 0 THEN '0' ELSE CAST(o_custkey % 30 + 1 AS VARCHAR) END AS home_id,
         CAST(CASE WHEN o_orderkey % 19 = 0 THEN o_custkey % 30 + 1 ELSE (o_custkey % 30 + 1 + o_orderkey % 29) % 30 + 1 END AS VARCHAR) AS away_id,
         CASE WHEN o_orderkey % 23 = 0 THEN ' TBD ' ELSE 'Team ' || (o_custkey % 30) END AS home_name, 'Team ' || (o_orderkey % 29) AS away_name,
         CASE o_orderstatus WHEN 'F' THEN ' Final' WHEN 'O' THEN 'Final/OT' ELSE '7:00 pm ET' END AS status,
         CASE WHEN o_orderkey % 29 <> 0 THEN CAST(80 + CAST(floor(o_totalprice) AS BIGINT) % 61 AS INTEGER) END AS home_score,
         CAST(80 + (o_orderkey * 7919 + o_custkey) % 61 AS INTEGER) AS away_score,
         o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS scheduled_at, o_orderkey % 37 = 0 AS postponed, o_orderkey % 50 = 0 AS is_neutral
  FROM orders)"""
SETTLED_CASE = """CASE WHEN game_id NOT LIKE '002%' THEN 'not_regular_season'
       WHEN home_id = '0' OR away_id = '0' OR home_id = away_id THEN 'unassigned_teams'
       WHEN trim(status) NOT LIKE 'Final%' THEN 'not_final' WHEN home_score IS NULL OR away_score IS NULL THEN 'missing_score'
       WHEN home_score = away_score THEN 'tied' ELSE 'settled' END"""


def provider_schedule(spark, sf_dir):
    """Provider schedule rows with every kind of unusable game in them."""
    from knowntime.functions.text import zero_fill
    o = V.table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    away = F.when(k % 19 == 0, c % 30 + 1).otherwise((c % 30 + 1 + k % 29) % 30 + 1)
    return o.select(
        zero_fill(F.lit(20000000) + F.when(k % 13 == 0, 10000000).otherwise(0) + k, 10).alias("game_id"),
        F.when(k % 17 == 0, "0").otherwise((c % 30 + 1).cast("string")).alias("home_id"), away.cast("string").alias("away_id"),
        F.when(k % 23 == 0, " TBD ").otherwise(F.concat(F.lit("Team "), c % 30)).alias("home_name"),
        F.concat(F.lit("Team "), k % 29).alias("away_name"),
        F.when(F.col("o_orderstatus") == "F", " Final").when(F.col("o_orderstatus") == "O", "Final/OT").otherwise("7:00 pm ET").alias("status"),
        F.when(k % 29 != 0, (80 + F.floor("o_totalprice") % 61).cast("int")).alias("home_score"),
        (80 + (k * 7919 + c) % 61).cast("int").alias("away_score"),
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (k % 24).cast("int"))).alias("scheduled_at"),
        (k % 37 == 0).alias("postponed"), (k % 50 == 0).alias("is_neutral"))


@query("settled_row_classes", "WITH " + SCHEDULE_SQL + f" SELECT {SETTLED_CASE} AS class, CAST(count(*) AS BIGINT) AS n FROM sched GROUP BY ALL")
def settled_row_classes(spark, sf_dir):
    """Schedule rows by class, first matching reason."""
    return provider_schedule(spark, sf_dir).groupBy(Q.settled_class().alias("class")).agg(F.count("*").alias("n"))


@query("schedule_assignment_split", "WITH " + SCHEDULE_SQL + """
SELECT game_id, CASE WHEN home_id = '0' OR away_id = '0' OR trim(home_name) IN ('', 'None', 'nan', 'TBD')
       OR trim(away_name) IN ('', 'None', 'nan', 'TBD') THEN 'pending' WHEN home_id = away_id THEN 'error' ELSE 'assigned' END AS part FROM sched""")
def schedule_assignment_split(spark, sf_dir):
    """Assigned games, rows awaiting teams, and impossible rows."""
    part = F.when(Q.unassigned(), "pending").when(F.col("home_id") == F.col("away_id"), "error").otherwise("assigned")
    return provider_schedule(spark, sf_dir).select("game_id", part.alias("part"))


def overrides(spark, sf_dir):
    """A reviewed list: one correction per nation, some of them against a stale state."""
    n, c = V.table(spark, sf_dir, "nation"), V.contests(spark, sf_dir)
    key = F.col("n_nationkey").cast("bigint")
    return (n.join(c.select("contest_id", "home_id", "away_id", "neutral"), key * 7 == F.col("contest_id"))
            .select(F.col("contest_id").alias("game_id"), F.when(key % 5 == 1, 1 - F.col("neutral")).otherwise(F.col("neutral")).alias("before"),
                    F.lit(1).alias("after"), F.when(key % 6 == 1, -1).otherwise(F.col("home_id")).alias("expected_home"),
                    F.col("away_id").alias("expected_away")))


OVERRIDES_SQL = "WITH " + V.CONTESTS + """, ov AS (
  SELECT contest_id AS game_id, CAST(CASE WHEN n_nationkey % 5 = 1 THEN 1 - neutral ELSE neutral END AS INTEGER) AS before, 1 AS after,
         CASE WHEN n_nationkey % 6 = 1 THEN -1 ELSE home_id END AS eh FROM nation JOIN contests ON contest_id = n_nationkey * 7)"""


@query("reviewed_overrides", OVERRIDES_SQL + """
SELECT c.contest_id AS game_id, CAST(CASE WHEN o.after IS NOT NULL AND o.before = c.neutral AND o.eh = c.home_id THEN o.after ELSE c.neutral END AS INTEGER) AS is_neutral
FROM contests c LEFT JOIN ov o ON o.game_id = c.contest_id""")
def reviewed_overrides(spark, sf_dir):
    """Corrections applied only where the before-state still holds."""
    g = V.contests(spark, sf_dir).select(F.col("contest_id").alias("game_id"), "home_id", "away_id", F.col("neutral").alias("is_neutral"))
    return Q.apply_overrides(g, overrides(spark, sf_dir))[0].select("game_id", "is_neutral")


@query("override_audit", OVERRIDES_SQL + """
SELECT o.game_id, o.before, o.after, CASE WHEN o.before = c.neutral AND o.eh = c.home_id THEN 'applied' ELSE 'state differs' END AS outcome
FROM ov o JOIN contests c ON c.contest_id = o.game_id""")
def override_audit(spark, sf_dir):
    """One audit row per reviewed correction."""
    g = V.contests(spark, sf_dir).select(F.col("contest_id").alias("game_id"), "home_id", "away_id", F.col("neutral").alias("is_neutral"))
    return Q.apply_overrides(g, overrides(spark, sf_dir))[1]


@query("contract_dispatch", """
SELECT CASE WHEN o_orderstatus = 'F' THEN 'nfl' WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'nfl' ELSE 'nba' END AS track,
       CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ALL""")
def contract_dispatch(spark, sf_dir):
    """Rule set chosen by the declared contract."""
    o = V.table(spark, sf_dir, "orders")
    st = F.col("o_orderstatus")
    rows = o.select(F.when(st == "F", "NFL").alias("sport"),
                    F.when((st == "O") & (F.col("o_orderkey") % 2 == 0), "nfl_regular").otherwise("nba_regular").alias("contract"))
    return rows.groupBy(Q.contract_of().alias("track")).agg(F.count("*").alias("n"))


def annotations(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    k = F.col("event_id")
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (k % n + 1).cast("int"))
    kind = pick(5, "evidence", "quality", "scenario", "narrative", "forecast")
    key = pick(7, "summary", "fair_price", "Edge_note", "probable", "p", "events", "stakeholder")
    src = F.struct(F.when(k % 6 != 5, F.concat(F.lit("https://example.org/"), k)).alias("url"),
                   F.when(k % 9 != 8, F.col("ts").cast("string")).otherwise("").alias("retrieved_at"))
    return e.select(k.alias("note_id"), F.concat(F.lit("agent"), F.col("user_id") % 7).alias("agent"), kind.alias("kind"),
                    F.create_map(key, F.col("props")).alias("body"),
                    F.when(k % 8 != 7, F.array(src)).otherwise(F.array().cast("array<struct<url:string,retrieved_at:string>>")).alias("sources"),
                    (k % 29 == 0).alias("adopted"))


NOTES_SQL = """notes AS (
  SELECT event_id AS note_id, 'agent' || (user_id % 7) AS agent, ['evidence', 'quality', 'scenario', 'narrative', 'forecast'][event_id % 5 + 1] AS kind,
         CASE WHEN event_id % 5 = 4 THEN 'unknown kind' WHEN event_id % 7 IN (1, 2, 4) THEN 'forecast or stake field'
              WHEN event_id % 8 = 7 THEN 'no source' WHEN event_id % 6 = 5 OR event_id % 9 = 8 THEN 'incomplete source'
              WHEN event_id % 29 = 0 THEN 'self-adopted' END AS reason FROM events)"""


@query("annotation_gate", "WITH " + NOTES_SQL + " SELECT note_id, kind, reason FROM notes")
def annotation_gate(spark, sf_dir):
    """Why each annotation is refused, if it is."""
    return annotations(spark, sf_dir).select("note_id", "kind", Q.annotation_reason().alias("reason"))


@query("annotation_summary", "WITH " + NOTES_SQL + " SELECT kind, agent, CAST(count(*) AS BIGINT) AS n FROM notes WHERE reason IS NULL GROUP BY ALL")
def annotation_summary(spark, sf_dir):
    """Accepted annotations by kind and agent."""
    ok = annotations(spark, sf_dir).where(Q.annotation_reason().isNull())
    return ok.groupBy("kind", "agent").agg(F.count("*").alias("n"))


BOUNDS = {"train": "1998-01-01", "tune": "1999-01-01", "calibration": "2000-01-01", "validation": "2001-01-01"}


@query("boundary_splits", "WITH " + V.PREDICTIONS + """
SELECT contest_id, CASE WHEN decision_at < '1998-01-01' THEN CASE WHEN available_at < '1998-01-01' THEN 'train' END
  WHEN decision_at < '1999-01-01' THEN CASE WHEN available_at < '1999-01-01' THEN 'tune' END
  WHEN decision_at < '2000-01-01' THEN CASE WHEN available_at < '2000-01-01' THEN 'calibration' END
  WHEN decision_at < '2001-01-01' THEN 'validation' END AS split FROM predictions WHERE decision_at >= '1995-01-01'""")
def boundary_splits(spark, sf_dir):
    """Split per contest; late labels leave the fitting splits only."""
    p = V.predictions(spark, sf_dir).where(F.col("decision_at") >= F.lit("1995-01-01").cast("timestamp_ntz"))
    return p.select("contest_id", S.split_column(BOUNDS, start="1995-01-01").alias("split"))


@query("split_guard", "WITH " + V.PREDICTIONS + """, s AS (
  SELECT y, neutral, CASE WHEN decision_at < '1998-01-01' THEN CASE WHEN available_at < '1998-01-01' THEN 'train' END
  WHEN decision_at < '1999-01-01' THEN CASE WHEN available_at < '1999-01-01' THEN 'tune' END
  WHEN decision_at < '2000-01-01' THEN CASE WHEN available_at < '2000-01-01' THEN 'calibration' END
  WHEN decision_at < '2001-01-01' THEN 'validation' END AS split FROM predictions WHERE decision_at >= '1995-01-01')
SELECT coalesce(split, 'left out') AS split, CAST(count(*) AS BIGINT) AS n, CAST(sum(y) AS BIGINT) AS positives,
       count(*) >= 30 AND sum(y) > 0 AND sum(y) < count(*) AS usable, CAST(sum(neutral) AS BIGINT) AS neutral FROM s GROUP BY ALL""")
def split_guard(spark, sf_dir):
    """Counts, classes and neutral flags per split."""
    p = V.predictions(spark, sf_dir).where(F.col("decision_at") >= F.lit("1995-01-01").cast("timestamp_ntz"))
    p = p.withColumn("split", F.coalesce(S.split_column(BOUNDS, start="1995-01-01"), F.lit("left out")))
    guard = S.split_guard(p, ["split"])
    return guard.join(p.groupBy("split").agg(F.sum("neutral").alias("neutral")), "split")


@query("season_folds", "WITH " + V.PREDICTIONS + """, f AS (SELECT unnest([1998, 1999, 2000]) AS fold),
first AS (SELECT season, min(decision_at) AS t FROM predictions GROUP BY season),
a AS (SELECT f.fold, p.*, CASE WHEN p.season = f.fold THEN 'validation' WHEN p.season = f.fold - 1 THEN 'calibration'
        WHEN p.season < f.fold - 1 AND p.available_at < x.t THEN 'fit' END AS split
      FROM predictions p CROSS JOIN f LEFT JOIN first x ON x.season = f.fold - 1)
SELECT fold, split, CAST(count(*) AS BIGINT) AS n, CAST(sum(y) AS BIGINT) AS positives,
       count(*) >= 30 AND sum(y) > 0 AND sum(y) < count(*) AS usable FROM a WHERE split IS NOT NULL GROUP BY ALL""")
def season_folds(spark, sf_dir):
    """Season-aligned folds."""
    return S.split_guard(S.season_folds(V.predictions(spark, sf_dir), (1998, 1999, 2000)), ["fold", "split"])


def _calendar_case(y):
    return f"""CASE WHEN decision_at < '1995-07-01' THEN NULL
      WHEN decision_at < '{y - 1}-07-01' THEN CASE WHEN available_at < '{y - 1}-07-01' THEN 'train' END
      WHEN decision_at < '{y}-01-01' THEN CASE WHEN available_at < '{y}-01-01' THEN 'tune' END
      WHEN decision_at < '{y}-07-01' THEN CASE WHEN available_at < '{y}-07-01' THEN 'calibration' END
      WHEN decision_at < '{y + 1}-07-01' THEN 'validation' END"""


@query("calendar_folds", "WITH " + V.PREDICTIONS + ", a AS (" + " UNION ALL ".join(
    f"SELECT {y} AS fold, {_calendar_case(y)} AS split, y FROM predictions" for y in (1997, 1998, 1999)) + """)
SELECT fold, split, CAST(count(*) AS BIGINT) AS n, CAST(sum(y) AS BIGINT) AS positives,
       count(*) >= 30 AND sum(y) > 0 AND sum(y) < count(*) AS usable FROM a WHERE split IS NOT NULL GROUP BY ALL""")
def calendar_folds(spark, sf_dir):
    """Three expanding folds in one pass."""
    return S.split_guard(S.calendar_folds(V.predictions(spark, sf_dir), (1997, 1998, 1999), start="1995-07-01"), ["fold", "split"])


@query("precutoff_window", "WITH " + V.CONTESTS + """
SELECT contest_id, decision_at FROM contests WHERE decision_at BETWEEN TIMESTAMP '1998-06-01 07:57:00' AND TIMESTAMP '1998-06-01 08:02:00'""")
def precutoff_window(spark, sf_dir):
    """Contests in the five minutes before their cutoff."""
    issue = F.lit("1998-06-01 07:57:00").cast("timestamp_ntz")
    return V.contests(spark, sf_dir).where(S.prewindow(issue)).select("contest_id", "decision_at")


@query("poll_window_targets", "WITH " + V.CONTESTS + """, served AS (SELECT decision_at AS cutoff FROM contests WHERE contest_id % 3 = 1)
SELECT contest_id, decision_at, round((epoch_us(TIMESTAMP '1998-06-01 08:03:00') - epoch_us(decision_at)) / 1000000.0::DOUBLE, 1) AS seconds_late
FROM contests WHERE abs(epoch_us(TIMESTAMP '1998-06-01 08:03:00') - epoch_us(decision_at)) <= 300000000 AND decision_at NOT IN (SELECT cutoff FROM served)""")
def poll_window_targets(spark, sf_dir):
    """Cutoffs due at a poll and not served before, with lateness."""
    c = V.contests(spark, sf_dir)
    served = c.where("contest_id % 3 = 1").select(F.col("decision_at").alias("cutoff"))
    return S.poll_targets(c.select("contest_id", "decision_at"), served, F.lit("1998-06-01 08:03:00").cast("timestamp_ntz"))


@query("degenerate_columns", """
SELECT unnest(['neutral', 'home_score', 'flag', 'home_id']) AS "column", unnest([a, b, c, d]) AS constant FROM (
  SELECT count(DISTINCT o_orderkey % 50 = 0) <= 1 AS a, count(DISTINCT floor(o_totalprice) % 61) <= 1 AS b, true AS c,
         count(DISTINCT o_custkey % 30) <= 1 AS d FROM orders)""")
def degenerate_columns(spark, sf_dir):
    """Columns that never vary."""
    c = V.contests(spark, sf_dir).withColumn("flag", F.lit(1))
    return Q.degenerate_columns(c, ["neutral", "home_score", "flag", "home_id"])


def captured_sources(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    k = F.col("event_id")
    name = (F.when(k % 997 == 0, "r1.pdf").when(k % 503 == 0, F.concat(F.lit("a/"), k))
            .otherwise(F.concat(F.lit("r"), k, F.lit(".pdf"))))
    return e.select(k.alias("source_id"), name.alias("filename"), F.when(k % 4 < 3, "prospective").otherwise("backfill").alias("capture"),
                    F.when(k % 53 != 0, F.col("ts")).alias("retrieved_at"),
                    (F.col("ts") - F.make_dt_interval(F.lit(0), F.lit(0), (k % 90 - 5).cast("int"))).alias("nominal_at"))


SOURCES_SQL = """src AS (
  SELECT event_id AS source_id, CASE WHEN event_id % 997 = 0 THEN 'r1.pdf' WHEN event_id % 503 = 0 THEN 'a/' || event_id ELSE 'r' || event_id || '.pdf' END AS filename,
         CASE WHEN event_id % 4 < 3 THEN 'prospective' ELSE 'backfill' END AS capture, CASE WHEN event_id % 53 <> 0 THEN ts END AS retrieved_at,
         ts - to_minutes(CAST(event_id % 90 - 5 AS INTEGER)) AS nominal_at FROM events)"""


@query("source_eligibility", "WITH " + SOURCES_SQL + """, n AS (SELECT *, count(*) OVER (PARTITION BY filename) AS copies FROM src)
SELECT source_id, CASE WHEN filename LIKE '%/%' THEN 'unsafe name' WHEN copies > 1 THEN 'duplicate name' WHEN capture <> 'prospective' THEN 'not prospective'
  WHEN retrieved_at IS NULL THEN 'no retrieval time'
  WHEN retrieved_at < TIMESTAMP '2024-01-13 12:00:00' OR retrieved_at >= TIMESTAMP '2024-01-15 12:00:00' THEN 'outside window'
  WHEN nominal_at > retrieved_at THEN 'report after retrieval' END AS reason FROM n""")
def source_eligibility(spark, sf_dir):
    """Captured sources usable at one instant, with reasons."""
    src = Q.with_copies(captured_sources(spark, sf_dir), "filename")
    return src.select("source_id", Q.source_reason(F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")).alias("reason"))


@query("coverage_gate", "WITH " + V.PREDICTIONS + """
SELECT season, CAST(count(*) AS BIGINT) AS n, min(y) <> max(y) AS both_classes, round(avg(CAST(contest_id % 7 <> season % 7 AS DOUBLE)), 6) AS coverage,
       count(*) >= 30 AND min(y) <> max(y) AND avg(CAST(contest_id % 7 <> season % 7 AS DOUBLE)) >= 0.86 AS passes FROM predictions GROUP BY ALL""")
def coverage_gate(spark, sf_dir):
    """Rows, classes and coverage per slice."""
    p = V.predictions(spark, sf_dir).withColumn("covered", F.col("contest_id") % 7 != F.col("season") % 7)
    return Q.coverage_gate(p, "season", covered="covered", min_coverage=0.86).select("season", "n", "both_classes", r6("coverage"), "passes")


@query("complete_lines_only", """
SELECT o_orderkey AS contest_id FROM orders WHERE o_orderkey % 5 <> 0 AND o_custkey % 7 <> 0""")
def complete_lines_only(spark, sf_dir):
    """Rows lacking a required measure are dropped before use."""
    o = V.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("contest_id"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("fga"),
        F.when(F.col("o_custkey") % 7 != 0, F.col("o_totalprice")).alias("tov"))
    return o.na.drop(subset=["fga", "tov"]).select("contest_id")
