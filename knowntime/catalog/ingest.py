"""Registered queries: scans, sinks, adapters, versions, merges, settlement and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from knowntime import views as V
from knowntime.catalog.features import r6
from knowntime.catalog.registry import query
from knowntime.catalog.rules import SCHEDULE_SQL, captured_sources, provider_schedule
from knowntime.functions.times import shift
from knowntime.operators import merge as M
from knowntime.session import scratch_path
from knowntime.sources import adapters as D, tables as S

GAME_SCHEMA = T.StructType([
    T.StructField("game_id", T.StringType()), T.StructField("home_id", T.StringType()),
    T.StructField("away_id", T.StringType()), T.StructField("scheduled_at", T.StringType()),
    T.StructField("home_score", T.IntegerType()), T.StructField("away_score", T.IntegerType())])


def text_games(spark, sf_dir):
    """Contests with zero-filled string ids, as files carry them."""
    from knowntime.functions.text import zero_fill
    c = V.contests(spark, sf_dir)
    return c.select(zero_fill("contest_id", 10).alias("game_id"), zero_fill("home_id", 3).alias("home_id"),
                    zero_fill("away_id", 3).alias("away_id"), F.date_format("scheduled_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("scheduled_at"),
                    "home_score", "away_score")


TEXT_GAMES = V.CONTESTS + """, tg AS (
  SELECT lpad(CAST(contest_id AS VARCHAR), 10, '0') AS game_id, lpad(CAST(home_id AS VARCHAR), 3, '0') AS home_id, lpad(CAST(away_id AS VARCHAR), 3, '0') AS away_id,
         strftime(scheduled_at, '%Y-%m-%dT%H:%M:%SZ') AS scheduled_at, home_score, away_score FROM contests)"""


@query("typed_csv_scan", "WITH " + TEXT_GAMES + " SELECT * FROM tg")
def typed_csv_scan(spark, sf_dir):
    """CSV scan with declared types; leading zeros survive (A1)."""
    path = scratch_path(spark, "csv")
    text_games(spark, sf_dir).write.option("header", True).csv(path)
    return S.read_csv(spark, path, GAME_SCHEMA)


@query("json_array_scan", "WITH " + TEXT_GAMES + " SELECT * FROM tg")
def json_array_scan(spark, sf_dir):
    """Many JSON-array files read by a glob (A2)."""
    path = scratch_path(spark, "json-arrays")
    g = text_games(spark, sf_dir).withColumn("_f", F.floor(F.col("game_id").cast("bigint") / 1000))
    arrays = g.groupBy("_f").agg(F.to_json(F.collect_list(F.struct(*GAME_SCHEMA.names))).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return S.read_json_arrays(spark, path + "/*.txt", GAME_SCHEMA)


@query("jsonl_scan", "WITH " + TEXT_GAMES + " SELECT * FROM tg")
def jsonl_scan(spark, sf_dir):
    """JSON-lines scan (A3)."""
    path = scratch_path(spark, "jsonl")
    text_games(spark, sf_dir).write.json(path)
    return S.read_jsonl(spark, path, GAME_SCHEMA)


@query("column_pruned_scan", "SELECT DISTINCT event_type AS source FROM events")
def column_pruned_scan(spark, sf_dir):
    """Distinct sources of a wide table: one column is read."""
    return V.table(spark, sf_dir, "events").select(F.col("event_type").alias("source")).distinct()


@query("snapshot_name_check", """
SELECT s_suppkey AS game_id, s_nationkey AS home_id, s_suppkey % 9 <> 0 AS name_ok FROM supplier""")
def snapshot_name_check(spark, sf_dir):
    """A folder of snapshot files is written and scanned; those filed under another game's hash are set apart."""
    path = scratch_path(spark, "snapshots")
    s, k = V.table(spark, sf_dir, "supplier"), F.col("game_id")
    snaps = s.select(F.col("s_suppkey").alias("game_id"), F.col("s_nationkey").alias("home_id"))
    S.write_snapshots(snaps, path, stem=F.sha2(F.when(k % 9 == 0, k + 1000000000).otherwise(k).cast("string"), 256))
    return S.check_snapshot_names(S.read_snapshots(spark, path, snaps.schema)).select("game_id", "home_id", "name_ok")


@query("write_once_sink", "WITH " + TEXT_GAMES + " SELECT CAST(count(*) AS BIGINT) AS n, true AS second_refused FROM tg")
def write_once_sink(spark, sf_dir):
    """A second write to the same output is refused."""
    path, g = scratch_path(spark, "once"), text_games(spark, sf_dir)
    S.write_once(g, path)
    try:
        S.write_once(g, path)
        refused = False
    except Exception as e:
        refused = "already exists" in str(e).lower() or "PATH_ALREADY_EXISTS" in str(e)
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.lit(refused).alias("second_refused"))


@query("append_sink", "WITH " + TEXT_GAMES + """
SELECT game_id, CAST(1 + CAST(CAST(game_id AS BIGINT) % 3 = 0 AS BIGINT) AS BIGINT) AS copies FROM tg""")
def append_sink(spark, sf_dir):
    """Append-only records."""
    path, g = scratch_path(spark, "append"), text_games(spark, sf_dir)
    S.append(g, path)
    S.append(g.where(F.col("game_id").cast("bigint") % 3 == 0), path)
    return spark.read.parquet(path).groupBy("game_id").agg(F.count("*").alias("copies"))


@query("insert_only_sink", "WITH " + TEXT_GAMES + """
SELECT game_id, CASE WHEN CAST(game_id AS BIGINT) % 2 = 0 THEN 'first' ELSE 'second' END AS batch FROM tg""")
def insert_only_sink(spark, sf_dir):
    """Exclusive creation per key: recorded rows are never replaced (A10)."""
    path = scratch_path(spark, "insert-only")
    g = text_games(spark, sf_dir).select("game_id")
    S.append(g.where(F.col("game_id").cast("bigint") % 2 == 0).withColumn("batch", F.lit("first")), path)
    for _ in range(2):
        S.insert_only(spark, g.withColumn("batch", F.lit("second")), path, ["game_id"])
    return spark.read.parquet(path).select("game_id", "batch")


@query("canonical_schedule", "WITH " + SCHEDULE_SQL + """, raw AS (
  SELECT *, CASE WHEN postponed THEN 'Y' WHEN game_id LIKE '%7' THEN 'N' END AS postponed_status, 0 AS row_no FROM sched
  UNION ALL SELECT * REPLACE ('again' AS home_name), NULL, 1 FROM sched WHERE is_neutral)
SELECT game_id, home_id, away_id, home_name, scheduled_at, observed_at, decision_at FROM (
  SELECT *, scheduled_at - INTERVAL 48 HOUR AS observed_at, scheduled_at - INTERVAL 1 HOUR AS decision_at, row_number() OVER (PARTITION BY game_id ORDER BY row_no) AS rn
  FROM raw WHERE game_id LIKE '002%' AND coalesce(postponed_status, '') IN ('', 'N', 'None')) WHERE rn = 1""")
def canonical_schedule(spark, sf_dir):
    """Provider schedule to canonical games, one per id."""
    p = provider_schedule(spark, sf_dir)
    first = p.withColumn("postponed_status", F.when(F.col("postponed"), "Y").when(F.col("game_id").endswith("7"), "N")).withColumn("row_no", F.lit(0))
    again = (p.where("is_neutral").withColumn("home_name", F.lit("again"))
             .withColumn("postponed_status", F.lit(None).cast("string")).withColumn("row_no", F.lit(1)))
    return D.canonical_schedule(first.unionByName(again)).select(
        "game_id", "home_id", "away_id", "home_name", "scheduled_at", "observed_at", "decision_at")


def local_games(spark, sf_dir):
    """Schedule rows with local kickoffs, some missing, some not regular season."""
    o = V.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("game_id"), F.when(k % 7 == 0, "POST").otherwise("REG").alias("game_type"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("gameday"),
        F.when(k % 11 != 0, F.format_string("%02d:%02d", (k % 12 + 10).cast("int"), (k % 4 * 15).cast("int"))).otherwise("TBD").alias("gametime"),
        F.when(k % 13 != 0, 80 + F.floor("o_totalprice") % 61).alias("home_score"), F.when(k % 13 != 0, 80 + k % 50).alias("away_score"),
        F.when(k % 5 == 0, 1).alias("overtime"))


LOCAL_SQL = """lg AS (
  SELECT o_orderkey AS game_id, timezone('UTC', timezone('America/New_York', o_orderdate + to_hours(CAST(o_orderkey % 12 + 10 AS INTEGER)) + to_minutes(CAST(o_orderkey % 4 * 15 AS INTEGER)))) AS scheduled_at,
         CASE WHEN o_orderkey % 13 <> 0 THEN CAST(80 + CAST(floor(o_totalprice) AS BIGINT) % 61 AS INTEGER) END AS home_score,
         CASE WHEN o_orderkey % 13 <> 0 THEN CAST(80 + o_orderkey % 50 AS INTEGER) END AS away_score, CAST(CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS INTEGER) AS overtime
  FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0)"""


@query("local_kickoff_schedule", "WITH " + LOCAL_SQL + """
SELECT game_id, scheduled_at, scheduled_at - INTERVAL 48 HOUR AS observed_at, scheduled_at - INTERVAL 1 HOUR AS decision_at FROM lg""")
def local_kickoff_schedule(spark, sf_dir):
    """Local kickoffs to UTC across daylight saving."""
    return D.tie_track_schedule(local_games(spark, sf_dir)).select("game_id", "scheduled_at", "observed_at", "decision_at")


@query("played_results", "WITH " + LOCAL_SQL + """
SELECT game_id, home_score, away_score, overtime, scheduled_at + INTERVAL 24 HOUR AS available_at FROM lg WHERE home_score IS NOT NULL""")
def played_results(spark, sf_dir):
    """Result rows of played games only."""
    return D.played_results(D.tie_track_schedule(local_games(spark, sf_dir)))


@query("team_log_results", "WITH " + V.CONTESTS + """
SELECT contest_id AS game_id, CASE WHEN ok THEN home_score END AS home_score, CASE WHEN ok THEN away_score END AS away_score,
       CASE WHEN ok THEN available_at END AS available_at, CASE WHEN NOT ok THEN 'need exactly two lines' END AS problem
FROM (SELECT *, contest_id % 97 <> 0 AND contest_id % 89 <> 0 AS ok FROM contests)""")
def team_log_results(spark, sf_dir):
    """Two team lines to one result, or a problem."""
    c = V.contests(spark, sf_dir)
    s = V.sides(c).select(F.col("contest_id").alias("game_id"), F.col("team").alias("team_id"), "side", F.col("scored").alias("pts"))
    log = (s.where("NOT (side = 'away' AND game_id % 97 = 0)").unionByName(s.where("side = 'home' AND game_id % 89 = 0"))
           .select("game_id", "team_id", "pts"))
    return D.results_from_team_log(c.select(F.col("contest_id").alias("game_id"), "home_id", "away_id", "scheduled_at"), log)


@query("schedule_cache_results", "WITH " + V.CONTESTS + """, j AS (
  SELECT contest_id AS game_id, home_score, away_score, available_at, CASE WHEN contest_id % 83 = 0 THEN 'no cached score' WHEN contest_id % 79 = 0 THEN 'team identity differs'
         WHEN contest_id % 73 = 0 THEN 'not a whole score' WHEN home_score = away_score THEN 'tied' END AS problem FROM contests)
SELECT game_id, CASE WHEN problem IS NULL THEN home_score END AS home_score, CASE WHEN problem IS NULL THEN away_score END AS away_score,
       CASE WHEN problem IS NULL THEN available_at END AS available_at, problem FROM j""")
def schedule_cache_results(spark, sf_dir):
    """Cached schedule scores to results with identity and integer checks."""
    c, k = V.contests(spark, sf_dir), F.col("contest_id")
    cache = c.where(k % 83 != 0).select(
        k.alias("game_id"), F.when(k % 79 == 0, -1).otherwise(F.col("home_id")).alias("home_team"), F.col("away_id").alias("away_team"),
        F.when(k % 73 == 0, 90.5).otherwise(F.col("home_score").cast("double")).alias("home_score"), F.col("away_score").cast("double").alias("away_score"), F.lit(0).alias("row_no"))
    twice = cache.where("game_id % 5 = 0").withColumn("home_score", F.lit(0.0)).withColumn("row_no", F.lit(1))
    return D.results_from_schedule(c.select(k.alias("game_id"), "home_id", "away_id", "scheduled_at"), cache.unionByName(twice))


@query("multi_season_union", """
SELECT year(l_shipdate)::INTEGER AS season, l_partkey AS player_id, l_quantity AS attempts, CASE WHEN l_returnflag <> 'R' THEN l_tax END AS extra
FROM lineitem WHERE l_linestatus = 'O'""")
def multi_season_union(spark, sf_dir):
    """Seasons with differing columns, concatenated and filtered."""
    li = V.table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("season"), F.col("l_partkey").alias("player_id"), F.col("l_quantity").alias("attempts"),
                                                   F.col("l_tax").alias("extra"), F.col("l_linestatus").alias("season_type"), "l_returnflag")
    parts = [li.where(F.col("l_returnflag") == f).drop(*(["extra", "l_returnflag"] if f == "R" else ["l_returnflag"])) for f in ("A", "N", "R")]
    return S.union_seasons(parts).where("season_type = 'O'").select("season", "player_id", "attempts", "extra")


@query("resumable_ingest", """
WITH s AS (SELECT o_orderkey AS source_id, o_custkey, o_totalprice, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS run FROM orders)
SELECT source_id, CAST(CASE WHEN source_id % 29 = 0 OR source_id % 31 = 0 THEN 0 ELSE 2 END AS INTEGER) AS n_rows,
       CASE WHEN source_id % 29 = 0 THEN 'unreadable' WHEN source_id % 31 = 0 THEN 'no rows' END AS reason, run,
       CASE WHEN source_id % 29 = 0 OR source_id % 31 = 0 THEN NULL ELSE o_custkey END AS player,
       CAST(0 AS INTEGER) AS taken_again, true AS drift_refused FROM s""")
def resumable_ingest(spark, sf_dir):
    """Two runs over growing sources, a third that adds nothing, and one refused because a source changed; bad sources are set
    aside with their reason (A18)."""
    o, k = V.table(spark, sf_dir, "orders"), F.col("source_id")
    body = F.when(k % 29 == 0, "{broken").when(k % 31 == 0, '{"rows": []}').otherwise(
        F.to_json(F.struct(F.array(*[F.struct(F.col("o_custkey").alias("player"), F.lit(n).alias("no")) for n in (1, 2)]).alias("rows"))))
    src = o.withColumn("source_id", F.col("o_orderkey")).select("source_id", body.alias("body")).withColumn("digest", F.sha2("body", 256))

    def parse(sources):
        read = F.from_json("body", "rows array<struct<player: bigint, no: int>>")["rows"]
        return sources.select("source_id", read.alias("parsed")).withColumn("reason", F.when(F.col("parsed").isNull(), "unreadable"))

    journal = S.Journal(spark, scratch_path(spark, "ingest"), "source_id", "1")
    journal.ingest(src.where(k % 3 != 0), "digest", parse)
    journal.ingest(src, "digest", parse)
    again = journal.ingest(src, "digest", parse)
    try:
        journal.ingest(src.withColumn("digest", F.when(k % 50 == 0, "other").otherwise(F.col("digest"))), "digest", parse)
        refused = False
    except ValueError:
        refused = True
    player = journal.rows().groupBy("source_id").agg(F.max("player").alias("player"))
    return journal.sources().join(player, "source_id", "left").select(
        "source_id", "n_rows", "reason", "run", "player", F.lit(again).alias("taken_again"), F.lit(refused).alias("drift_refused"))


@query("table_fingerprint", "WITH " + V.CONTESTS + """, d AS (SELECT ('0x' || substr(md5(concat_ws('|', contest_id, home_id, away_id, home_score, away_score)), 1, 8))::UBIGINT::BIGINT AS d FROM contests)
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(sum(d) AS BIGINT) AS digest_sum, bit_xor(d) AS digest_xor FROM d""")
def table_fingerprint(spark, sf_dir):
    """Order-insensitive content fingerprint."""
    return S.fingerprint(V.contests(spark, sf_dir), ["contest_id", "home_id", "away_id", "home_score", "away_score"])


@query("resumable_ingest_plan", """
SELECT event_id AS source_id, CASE WHEN event_id % 4 <> 0 THEN 'parse' WHEN event_id % 44 = 0 THEN 'refuse' ELSE 'skip' END AS action FROM events""")
def resumable_ingest_plan(spark, sf_dir):
    """Skip parsed sources, refuse drifted ones, parse the rest."""
    src = captured_sources(spark, sf_dir).select("source_id", F.sha2(F.concat_ws("|", "filename", "nominal_at"), 256).alias("digest"))
    k = F.col("source_id")
    done = src.where(k % 4 == 0).withColumn("digest", F.when(k % 44 == 0, "changed").otherwise(F.col("digest")))
    return S.ingest_plan(src, done, "source_id", "digest").select("source_id", "action")


def two_versions(spark, sf_dir):
    """A schedule and its next edition: games added, withdrawn, moved and renamed."""
    c = V.contests(spark, sf_dir).select(F.col("contest_id").alias("game_id"), "scheduled_at", "decision_at", "home_id", "neutral")
    k = F.col("game_id")
    hours = F.make_dt_interval(F.lit(0), F.when(k % 13 == 0, 3).otherwise(0))
    new = (c.where(k % 11 != 0).withColumn("scheduled_at", F.col("scheduled_at") + hours).withColumn("decision_at", F.col("decision_at") + hours)
           .withColumn("neutral", F.when(k % 17 == 0, 1 - F.col("neutral")).otherwise(F.col("neutral"))))
    return c.where(k % 10 != 0), new


VERSIONS = V.CONTESTS + """, cur AS (SELECT contest_id AS game_id, scheduled_at, decision_at, home_id, neutral FROM contests WHERE contest_id % 10 <> 0),
nxt AS (SELECT contest_id AS game_id, scheduled_at + to_hours(CASE WHEN contest_id % 13 = 0 THEN 3 ELSE 0 END) AS scheduled_at,
        decision_at + to_hours(CASE WHEN contest_id % 13 = 0 THEN 3 ELSE 0 END) AS decision_at, home_id,
        CAST(CASE WHEN contest_id % 17 = 0 THEN 1 - neutral ELSE neutral END AS INTEGER) AS neutral FROM contests WHERE contest_id % 11 <> 0)"""
CHANGES = """, ch AS (SELECT coalesce(c.game_id, n.game_id) AS game_id, c.{t} AS before, n.{t} AS after,
  CASE WHEN c.game_id IS NULL THEN 'added' WHEN n.game_id IS NULL THEN 'withdrawn' WHEN c.{t} <> n.{t} THEN 'revised' ELSE 'unchanged' END AS change
  FROM cur c FULL JOIN nxt n ON c.game_id = n.game_id)"""


@query("schedule_revision_log", "WITH " + VERSIONS + CHANGES.format(t="scheduled_at") + " SELECT * FROM ch WHERE change <> 'unchanged'")
def schedule_revision_log(spark, sf_dir):
    """Added, withdrawn and moved games (C14)."""
    return M.schedule_changes(*two_versions(spark, sf_dir)).where("change <> 'unchanged'").select("game_id", "before", "after", "change")


@query("schedule_merge_times", "WITH " + VERSIONS + """
SELECT n.game_id, n.scheduled_at, n.decision_at, n.home_id, coalesce(c.neutral, n.neutral) AS neutral FROM nxt n LEFT JOIN cur c USING (game_id)""")
def schedule_merge_times(spark, sf_dir):
    """New times, other columns of known games unchanged (C14)."""
    return M.merge_times_only(*two_versions(spark, sf_dir)).select("game_id", "scheduled_at", "decision_at", "home_id", "neutral")


@query("schedule_replace_diff", "WITH " + VERSIONS + CHANGES.format(t="decision_at") + " SELECT change, CAST(count(*) AS BIGINT) AS n FROM ch GROUP BY ALL")
def schedule_replace_diff(spark, sf_dir):
    """Replacement refresh: games by kind of change."""
    ch = M.schedule_changes(*two_versions(spark, sf_dir), time="decision_at")
    return ch.groupBy("change").agg(F.count("*").alias("n"))


@query("incremental_fact_merge", "WITH " + V.CONTESTS + """
SELECT contest_id AS game_id, CAST(CASE WHEN contest_id % 4 = 0 AND contest_id % 3 <> 0 THEN home_score + 1 ELSE home_score END AS INTEGER) AS home_score
FROM contests WHERE contest_id % 3 = 0 OR contest_id % 4 = 0""")
def incremental_fact_merge(spark, sf_dir):
    """Base plus new keys, merged twice with the same result."""
    c = V.contests(spark, sf_dir).select(F.col("contest_id").alias("game_id"), "home_score")
    base = c.where("game_id % 3 = 0")
    new = c.where("game_id % 4 = 0").withColumn("home_score", F.col("home_score") + 1)
    return M.merge_facts(M.merge_facts(base, new), new)


@query("record_settlement", "WITH " + V.CONTESTS + """
SELECT contest_id AS game_id, CASE WHEN contest_id % 19 = 0 THEN 'void' WHEN contest_id % 7 = 0 THEN 'pending' ELSE 'settled' END AS status,
       CASE WHEN contest_id % 19 = 0 OR contest_id % 7 = 0 THEN NULL WHEN home_score > away_score THEN 'home' WHEN home_score < away_score THEN 'away' ELSE 'tie' END AS outcome,
       CASE WHEN contest_id % 19 = 0 OR contest_id % 7 = 0 THEN NULL WHEN home_score = away_score THEN 'push' ELSE 'win_or_lose' END AS moneyline
FROM contests WHERE contest_id % 2 = 0""")
def record_settlement(spark, sf_dir):
    """Recorded forecasts settled, pending or void; ties push (C17)."""
    c = V.contests(spark, sf_dir).withColumnRenamed("contest_id", "game_id")
    return M.settle_records(c.where("game_id % 2 = 0").select("game_id"), c.where("game_id % 19 <> 0"), c.where("game_id % 7 <> 0")).select(
        "game_id", "status", "outcome", "moneyline")


@query("semi_join_new_results", "WITH " + V.CONTESTS + """
SELECT contest_id AS game_id, home_score FROM contests WHERE contest_id % 5 <> 0 AND contest_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def semi_join_new_results(spark, sf_dir):
    """Rows whose key is in a set."""
    c = V.contests(spark, sf_dir).where("contest_id % 5 <> 0").select(F.col("contest_id").alias("game_id"), "home_score")
    keys = V.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("game_id"))
    return c.join(keys, "game_id", "left_semi")


@query("anti_join_missed", "WITH " + V.CONTESTS + """
SELECT contest_id AS game_id FROM contests WHERE decision_at < TIMESTAMP '2000-01-01' AND contest_id NOT IN (SELECT l_orderkey FROM lineitem)""")
def anti_join_missed(spark, sf_dir):
    """Past cutoffs without a record."""
    c = V.contests(spark, sf_dir).where(F.col("decision_at") < F.lit("2000-01-01").cast("timestamp_ntz")).select(F.col("contest_id").alias("game_id"))
    return c.join(V.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("game_id")), "game_id", "left_anti")


@query("decisions_left_settlements", "WITH " + V.CONTESTS + """
SELECT c.contest_id AS game_id, c.decision_at, CASE WHEN contest_id % 3 = 0 THEN home_score - away_score END AS pnl FROM contests c""")
def decisions_left_settlements(spark, sf_dir):
    """Every decision with its settlement where there is one."""
    c = V.contests(spark, sf_dir).withColumnRenamed("contest_id", "game_id")
    settled = c.where("game_id % 3 = 0").select("game_id", (F.col("home_score") - F.col("away_score")).alias("pnl"))
    return c.select("game_id", "decision_at").join(settled, "game_id", "left")


@query("validated_one_to_one_join", "WITH " + V.CONTESTS + """
SELECT c.contest_id AS game_id, o_totalprice AS price FROM contests c JOIN orders ON o_orderkey = contest_id""")
def validated_one_to_one_join(spark, sf_dir):
    """Inner join after both sides' keys were proven unique."""
    from knowntime.operators.quality import require_clean, suite, unique_rule
    c = V.contests(spark, sf_dir).select(F.col("contest_id").alias("game_id"))
    o = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("game_id"), F.col("o_totalprice").alias("price"))
    require_clean(suite(unique_rule(c, "left keys", ["game_id"]), unique_rule(o, "right keys", ["game_id"])))
    return c.join(o, "game_id")


@query("id_set_equality", """
SELECT o_orderkey AS key, 'left' AS only_in FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def id_set_equality(spark, sf_dir):
    """Keys found on one side only."""
    o = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    li = V.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"))
    return M.set_differences(o, li, "key")


@query("id_intersection", "SELECT DISTINCT l_orderkey AS key FROM lineitem WHERE l_tax > 0.05 INTERSECT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def id_intersection(spark, sf_dir):
    """Keys present on both sides."""
    li = V.table(spark, sf_dir, "lineitem").where("l_tax > 0.05").select(F.col("l_orderkey").alias("key"))
    return li.intersect(V.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("key")))


@query("latest_decisions", "WITH " + V.CONTESTS + """
SELECT contest_id AS game_id, decision_at FROM contests ORDER BY decision_at DESC, contest_id DESC LIMIT 50""")
def latest_decisions(spark, sf_dir):
    """The fifty latest decisions."""
    c = V.contests(spark, sf_dir).select(F.col("contest_id").alias("game_id"), "decision_at")
    return c.orderBy(F.desc("decision_at"), F.desc("game_id")).limit(50)


@query("last_revision_per_key", "SELECT l_orderkey AS game_id, max(l_linenumber) AS revision, CAST(count(*) AS BIGINT) AS revisions FROM lineitem GROUP BY ALL")
def last_revision_per_key(spark, sf_dir):
    """Last row per key without sorting whole groups (F1)."""
    li = V.table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("game_id")).agg(F.max("l_linenumber").alias("revision"), F.count("*").alias("revisions"))


@query("scalar_functions", """
SELECT o_orderkey AS id, lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS filled, substr(lpad(CAST(o_orderkey AS VARCHAR), 10, '0'), 4, 2) AS season,
       sha256(CAST(o_orderkey AS VARCHAR)) AS digest, strftime(o_orderdate, '%Y-%m') AS month, CAST(week(o_orderdate) AS INTEGER) AS iso_week,
       CAST(floor((epoch_us(o_orderdate)) / (7 * 86400000000)) AS BIGINT) AS block, round(ln(p / (1 - p)), 6) AS logit, round(1 / (1 + exp(-ln(p / (1 - p)) * 0.5)), 6) AS shrunk,
       round(greatest(z, 0) + ln(1 + exp(-abs(z))), 6) AS softplus, floor(o_totalprice / 25) * 25 AS floored
FROM (SELECT *, least(greatest((o_orderkey % 101) / 100.0::DOUBLE, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS p, ((o_orderkey % 2001) - 1000) / 77.0::DOUBLE AS z FROM orders)""")
def scalar_functions(spark, sf_dir):
    """Clipped logit, stable softplus, zero fill, hashes, ISO weeks, epoch blocks (G)."""
    from knowntime.functions.prob import expit, logit, softplus
    from knowntime.functions.text import zero_fill
    from knowntime.functions.times import epoch_block
    o = V.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    p, z = (k % 101) / F.lit(100.0), ((k % 2001) - 1000) / F.lit(77.0)
    return o.select(k.alias("id"), zero_fill(k, 10).alias("filled"), F.substring(zero_fill(k, 10), 4, 2).alias("season"),
                    F.sha2(k.cast("string"), 256).alias("digest"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.weekofyear("o_orderdate").alias("iso_week"),
                    epoch_block("o_orderdate").alias("block"), r6("logit", logit(p)), r6("shrunk", expit(logit(p) * 0.5)), r6("softplus", softplus(z)),
                    (F.floor(F.col("o_totalprice") / 25) * 25).cast("double").alias("floored"))
