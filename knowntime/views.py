"""The point-in-time model over the given tables: Spark views and the same views as SQL.

Each view exists twice, as a DataFrame (what the operators read) and as a SQL common table
expression (what the checking SQL reads).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from knowntime.functions.times import shift

REFERENCE_BOOKS = ("click", "error", "purchase")
EXECUTION_BOOKS = ("signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(frame: DataFrame) -> DataFrame:
    """Deal rows evenly before heavy per-row work, whatever files they came in."""
    return frame.repartition(frame.sparkSession.sparkContext.defaultParallelism)


def contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedule and result of every contest: one row per order."""
    o = table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    start = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (key % 24).cast("int"))
    return (o.select(
        key.alias("contest_id"), F.col("o_orderpriority").alias("league"),
        (cust % 30).alias("home_id"), ((cust % 30 + 1 + key % 29) % 30).alias("away_id"),
        start.alias("scheduled_at"),
        (80 + F.floor("o_totalprice") % 61).cast("int").alias("home_score"),
        (80 + (key * 7919 + cust) % 61).cast("int").alias("away_score"),
        (key % 50 == 0).cast("int").alias("neutral"))
        .withColumn("observed_at", shift("scheduled_at", hours=-48))
        .withColumn("decision_at", shift("scheduled_at", hours=-1))
        .withColumn("available_at", shift("scheduled_at", hours=24))
        .withColumn("season", F.year("scheduled_at")))


CONTESTS = """contests AS (
  SELECT *, scheduled_at - INTERVAL 48 HOUR AS observed_at,
         scheduled_at - INTERVAL 1 HOUR AS decision_at,
         scheduled_at + INTERVAL 24 HOUR AS available_at,
         CAST(year(scheduled_at) AS INTEGER) AS season
  FROM (SELECT o_orderkey AS contest_id, o_orderpriority AS league,
               o_custkey % 30 AS home_id, (o_custkey % 30 + 1 + o_orderkey % 29) % 30 AS away_id,
               o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS scheduled_at,
               CAST(80 + CAST(floor(o_totalprice) AS BIGINT) % 61 AS INTEGER) AS home_score,
               CAST(80 + (o_orderkey * 7919 + o_custkey) % 61 AS INTEGER) AS away_score,
               CAST(o_orderkey % 50 = 0 AS INTEGER) AS neutral
        FROM orders))"""


def sides(frame: DataFrame) -> DataFrame:
    """One row per contest and side: entity, opponent, points for and against, outcome."""
    margin = F.col("home_score") - F.col("away_score")
    win = F.when(margin > 0, 1.0).when(margin < 0, 0.0).otherwise(0.5)
    home = F.struct(F.lit("home").alias("side"), F.col("home_id").alias("team"),
                    F.col("away_id").alias("opponent"), F.col("home_score").alias("scored"),
                    F.col("away_score").alias("allowed"), win.alias("win"))
    away = F.struct(F.lit("away").alias("side"), F.col("away_id").alias("team"),
                    F.col("home_id").alias("opponent"), F.col("away_score").alias("scored"),
                    F.col("home_score").alias("allowed"), (F.lit(1.0) - win).alias("win"))
    return (frame.withColumn("_side", F.explode(F.array(home, away)))
            .select(*[c for c in frame.columns], "_side.*"))


SIDES = CONTESTS + """, sides AS (
  SELECT contest_id, league, season, neutral, scheduled_at, decision_at, available_at, 'home' AS side,
         home_id AS team, away_id AS opponent, home_score AS scored, away_score AS allowed,
         CASE WHEN home_score > away_score THEN 1.0 WHEN home_score < away_score THEN 0.0
              ELSE 0.5 END::DOUBLE AS win
  FROM contests UNION ALL
  SELECT contest_id, league, season, neutral, scheduled_at, decision_at, available_at, 'away',
         away_id, home_id, away_score, home_score,
         CASE WHEN away_score > home_score THEN 1.0 WHEN away_score < home_score THEN 0.0
              ELSE 0.5 END::DOUBLE
  FROM contests)"""


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided price quotes: one row per event."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("quote_id"), F.col("user_id").alias("contest_id"),
        F.col("event_type").alias("book"), F.col("ts").alias("quote_at"),
        (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("event_id") % 7).cast("int")))
        .alias("available_at"),
        (1.05 + F.col("value") / 100).alias("home_odds"),
        (1.05 + (500 - F.least(F.col("value"), F.lit(499.0))) / 100).alias("away_odds"))


QUOTES = """quotes AS (
  SELECT event_id AS quote_id, user_id AS contest_id, event_type AS book, ts AS quote_at,
         ts + to_minutes(CAST(event_id % 7 AS INTEGER)) AS available_at,
         1.05::DOUBLE + value / 100 AS home_odds,
         1.05::DOUBLE + (500 - least(value, 499.0::DOUBLE)) / 100 AS away_odds
  FROM events)"""


def quote_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One decision per contest and day at 18:00."""
    e = table(spark, sf_dir, "events")
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    return (e.select(F.col("user_id").alias("contest_id"), day.alias("_day")).distinct()
            .select("contest_id", shift("_day", hours=18).alias("decision_at")))


DECISIONS = """decisions AS (
  SELECT DISTINCT user_id AS contest_id, date_trunc('day', ts) + INTERVAL 18 HOUR AS decision_at
  FROM events)"""

STATUS_OF_TYPE = {"click": "Out", "error": "Doubtful", "purchase": "Questionable",
                  "signup": "Probable", "view": "NotSubmitted"}


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status reports: snapshots per (team, report time), several rows each."""
    e = table(spark, sf_dir, "events")
    status = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v))
                          for k, v in STATUS_OF_TYPE.items()])
    status = F.when(F.col("event_id") % 11 == 0, F.lit("Available")).otherwise(status)
    team, gap = F.col("user_id") % 30, F.col("event_id") % 3
    # A report is about one game of its team: at home, or away.
    home = F.when(F.floor(F.col("event_id") / 3) % 2 == 0, team).otherwise((team + 29 - gap) % 30)
    return e.select(
        F.col("event_id").alias("row_id"), team.alias("team_id"), home.alias("home_id"), ((home + 1 + gap) % 30).alias("away_id"),
        F.when(status != "NotSubmitted", F.col("user_id")).alias("player_id"),
        status.alias("status"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("report_at"),
        F.when(F.col("event_id") % 41 == 0, "late").otherwise("main").alias("source"))


REPORTS = """reports AS (
  SELECT row_id, team_id, home_id, (home_id + 1 + row_id % 3) % 30 AS away_id, CASE WHEN status <> 'NotSubmitted' THEN user_id END AS player_id, status,
         report_at, source
  FROM (SELECT event_id AS row_id, user_id % 30 AS team_id, user_id,
               CASE WHEN event_id // 3 % 2 = 0 THEN user_id % 30 ELSE (user_id % 30 + 29 - event_id % 3) % 30 END AS home_id,
               CASE WHEN event_id % 11 = 0 THEN 'Available'
                    ELSE CASE event_type WHEN 'click' THEN 'Out' WHEN 'error' THEN 'Doubtful'
                         WHEN 'purchase' THEN 'Questionable' WHEN 'signup' THEN 'Probable'
                         ELSE 'NotSubmitted' END END AS status,
               date_trunc('hour', ts)::TIMESTAMP AS report_at,
               CASE WHEN event_id % 41 = 0 THEN 'late' ELSE 'main' END AS source FROM events))"""


def report_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games whose status reports are looked up: one per event day, pair and hour."""
    e = table(spark, sf_dir, "events")
    home = F.col("user_id") % 30
    start = shift(F.date_trunc("day", "ts").cast("timestamp_ntz"), hours=20)
    return (e.select(home.alias("home_id"), ((home + 1 + F.col("event_id") % 3) % 30).alias("away_id"),
                     start.alias("scheduled_at")).distinct()
            .withColumn("decision_at", shift("scheduled_at", hours=-1))
            .withColumn("game_id", F.concat_ws("-", F.date_format("scheduled_at", "yyyyMMdd"),
                                               "home_id", "away_id")))


REPORT_GAMES = """report_games AS (
  SELECT *, scheduled_at - INTERVAL 1 HOUR AS decision_at,
         strftime(scheduled_at, '%Y%m%d') || '-' || home_id || '-' || away_id AS game_id
  FROM (SELECT DISTINCT user_id % 30 AS home_id, (user_id % 30 + 1 + event_id % 3) % 30 AS away_id,
               date_trunc('day', ts)::TIMESTAMP + INTERVAL 20 HOUR AS scheduled_at FROM events))"""


def box_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box measures per contest and side, summed from line items (partial sums map-side)."""
    li = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity")
    return (li.withColumn("side", F.when(F.col("l_linenumber") % 2 == 0, "home").otherwise("away"))
            .groupBy(F.col("l_orderkey").alias("contest_id"), "side")
            .agg(F.sum(q).alias("fga"), F.sum(F.floor(q * F.lit(0.45))).cast("double").alias("fgm"),
                 F.sum(F.floor(q * F.lit(0.125))).cast("double").alias("fg3m"),
                 F.sum(F.floor(q * F.lit(0.25))).cast("double").alias("fta"),
                 F.sum(F.col("l_partkey") % 5).cast("double").alias("oreb"),
                 F.sum(F.col("l_suppkey") % 4).cast("double").alias("tov")))


BOX = """box AS (
  SELECT l_orderkey AS contest_id, CASE WHEN l_linenumber % 2 = 0 THEN 'home' ELSE 'away' END AS side,
         sum(l_quantity) AS fga, CAST(sum(floor(l_quantity * 0.45::DOUBLE)) AS DOUBLE) AS fgm,
         CAST(sum(floor(l_quantity * 0.125::DOUBLE)) AS DOUBLE) AS fg3m,
         CAST(sum(floor(l_quantity * 0.25::DOUBLE)) AS DOUBLE) AS fta,
         CAST(sum(l_partkey % 5) AS DOUBLE) AS oreb, CAST(sum(l_suppkey % 4) AS DOUBLE) AS tov
  FROM lineitem GROUP BY ALL)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored contests: outcome and the probabilities of a model and of a baseline."""
    c = contests(spark, sf_dir)
    k, h = F.col("contest_id"), F.col("home_id")
    return c.select(
        "contest_id", "league", "season", "neutral", "decision_at", "available_at",
        (F.col("home_score") > F.col("away_score")).cast("int").alias("y"),
        (F.col("home_score") == F.col("away_score")).cast("int").alias("is_tie"),
        ((F.lit(1) + (k * 31 + h * 17) % 97) / F.lit(99.0)).alias("p_model"),
        ((F.lit(1) + (k * 13 + h * 5) % 89) / F.lit(91.0)).alias("p_base"))


PREDICTIONS = CONTESTS + """, predictions AS (
  SELECT contest_id, league, season, neutral, decision_at, available_at,
         CAST(home_score > away_score AS INTEGER) AS y, CAST(home_score = away_score AS INTEGER) AS is_tie,
         (1 + (contest_id * 31 + home_id * 17) % 97) / 99.0::DOUBLE AS p_model,
         (1 + (contest_id * 13 + home_id * 5) % 89) / 91.0::DOUBLE AS p_base
  FROM contests)"""


def bets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policy rows: a model probability beside two-sided prices, per account."""
    o = table(spark, sf_dir, "orders")
    c = contests(spark, sf_dir).drop("league")
    acct = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("account"))
    k = F.col("contest_id")
    return (c.join(o.select(F.col("o_orderkey").alias("contest_id"), "o_custkey"), "contest_id")
            .join(acct, F.col("o_custkey") == F.col("c_custkey"))
            .select("account", "contest_id", "scheduled_at", "decision_at",
                    F.col("available_at").alias("result_available_at"),
                    (F.col("home_score") > F.col("away_score")).cast("int").alias("y"),
                    ((F.lit(1) + (k * 31 + F.col("home_id") * 17) % 97) / F.lit(99.0)).alias("p_model"),
                    (F.lit(1.2) + (k * 37 % 211) / F.lit(100.0)).alias("home_odds"),
                    (F.lit(1.2) + (k * 53 % 223) / F.lit(100.0)).alias("away_odds"),
                    F.concat(F.lit("book"), (k % 5).cast("string")).alias("home_book"),
                    F.concat(F.lit("book"), (k % 3).cast("string")).alias("away_book")))


BETS = CONTESTS + """, bets AS (
  SELECT c_mktsegment AS account, contest_id, scheduled_at, decision_at,
         available_at AS result_available_at, CAST(home_score > away_score AS INTEGER) AS y,
         (1 + (contest_id * 31 + home_id * 17) % 97) / 99.0::DOUBLE AS p_model,
         1.2::DOUBLE + (contest_id * 37 % 211) / 100.0::DOUBLE AS home_odds,
         1.2::DOUBLE + (contest_id * 53 % 223) / 100.0::DOUBLE AS away_odds,
         'book' || (contest_id % 5) AS home_book, 'book' || (contest_id % 3) AS away_book
  FROM contests JOIN orders ON contest_id = o_orderkey JOIN customer ON o_custkey = c_custkey)"""
