"""Registered queries: streaming forms, run to completion over files made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from knowntime import views as V
from knowntime.catalog.features import AFTER_SQL, r6
from knowntime.catalog.registry import query
from knowntime.operators.ratings import with_outcome
from knowntime.sources.tables import append
from knowntime.streaming import polls as P, ratings as R

EVENT_EDGES = ("2024-01-08", "2024-01-15", "2024-01-22")
CONTEST_EDGES = ("1997-01-01", "1999-01-01", "2000-06-01")


def _poll_rows(spark, sf_dir):
    c = V.contests(spark, sf_dir).select(F.col("decision_at").cast("timestamp").alias("cutoff")).distinct()
    again = F.explode(F.array(*[F.lit(m) for m in (-4, 0, 4)]))
    return c.withColumn("_m", again).select("cutoff", (F.col("cutoff") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("_m"))).alias("polled_at"))


@query("stream_idempotent_poll", "WITH " + V.CONTESTS + " SELECT DISTINCT decision_at AS cutoff FROM contests")
def stream_idempotent_poll(spark, sf_dir):
    """Every cutoff is served once however often it is polled (L1)."""
    src, out, ck = P.fresh_paths(spark, "polls", "in", "out", "checkpoint")
    rows = _poll_rows(spark, sf_dir)
    P.write_in_order(rows, src, "polled_at", CONTEST_EDGES)
    got = P.run_available(P.served_once(P.stream_files(spark, src, rows.schema)), out, ck)
    return got.select(F.col("cutoff").cast("timestamp_ntz").alias("cutoff"))


@query("stream_late_refusal", "WITH " + V.CONTESTS + """
SELECT contest_id, CASE WHEN contest_id % 9 - 7 > 0 THEN 'late' ELSE 'issued' END AS part FROM contests""")
def stream_late_refusal(spark, sf_dir):
    """Forecasts past their cutoff are refused and kept aside (L2)."""
    src, ok, late, ck = P.fresh_paths(spark, "late", "in", "issued", "late", "checkpoint")
    minutes = (F.col("contest_id") % 9 - 7).cast("int")
    rows = V.contests(spark, sf_dir).select("contest_id", "decision_at", (F.col("decision_at") + F.make_dt_interval(F.lit(0), F.lit(0), minutes)).alias("issued_at"))
    P.write_in_order(rows, src, "issued_at", CONTEST_EDGES)
    P.split_late(P.stream_files(spark, src, rows.schema), ok, late, ck)
    return (spark.read.parquet(ok).select("contest_id", F.lit("issued").alias("part"))
            .unionByName(spark.read.parquet(late).select("contest_id", F.lit("late").alias("part"))))


@query("stream_fresh_quotes", "WITH " + V.QUOTES + ", " + V.DECISIONS + """
SELECT d.contest_id, d.decision_at, q.book, q.quote_id, q.available_at FROM decisions d JOIN quotes q ON q.contest_id = d.contest_id
 AND q.available_at BETWEEN d.decision_at - INTERVAL 6 HOUR AND d.decision_at""")
def stream_fresh_quotes(spark, sf_dir):
    """Decisions joined with recent quotes, stream to stream (L3)."""
    ds, qs, out, ck = P.fresh_paths(spark, "fresh", "decisions", "quotes", "out", "checkpoint")
    d = V.quote_decisions(spark, sf_dir).withColumn("decision_at", F.col("decision_at").cast("timestamp"))
    q = V.quotes(spark, sf_dir).select("quote_id", "contest_id", "book", F.col("available_at").cast("timestamp").alias("available_at"))
    P.write_in_order(d, ds, "decision_at", EVENT_EDGES)
    P.write_in_order(q, qs, "available_at", EVENT_EDGES)
    got = P.run_available(P.fresh_quotes(P.stream_files(spark, ds, d.schema), P.stream_files(spark, qs, q.schema),
                                         max_age="6 hours", delay="10 minutes"), out, ck)
    return got.select("contest_id", F.col("decision_at").cast("timestamp_ntz").alias("decision_at"), "book", "quote_id",
                      F.col("available_at").cast("timestamp_ntz").alias("available_at"))


@query("stream_ratings", AFTER_SQL)
def stream_ratings(spark, sf_dir):
    """Ratings kept in a state store; equals the batch fold (L4)."""
    src, out, ck = P.fresh_paths(spark, "ratings", "in", "out", "checkpoint")
    c = with_outcome(V.contests(spark, sf_dir).where("home_score <> away_score"))
    rows = c.select("league", "contest_id", "home_id", "away_id", "outcome", "neutral", F.col("available_at").cast("timestamp").alias("available_at"))
    P.write_in_order(rows, src, "available_at", CONTEST_EDGES)
    # A closing row per pool moves the watermark past the last result; it is never applied.
    end = rows.select("league").distinct().select(
        "league", F.lit(-1).cast("bigint").alias("contest_id"), F.lit(0).cast("bigint").alias("home_id"), F.lit(1).cast("bigint").alias("away_id"),
        F.lit(0.5).alias("outcome"), F.lit(0).alias("neutral"), F.lit("2100-01-01 00:00:00").cast("timestamp").alias("available_at"))
    append(end, src)
    got = P.run_available(R.rating_stream(P.stream_files(spark, src, rows.schema), stretch_days=28), out, ck, map_state=True)
    return got.select("league", "contest_id", r6("home_rating"), r6("away_rating"))


@query("stream_enrichment", "WITH " + V.QUOTES + """
SELECT quote_id, book, c_name AS name, c_mktsegment AS account FROM quotes JOIN customer ON c_custkey = contest_id""")
def stream_enrichment(spark, sf_dir):
    """Streaming quotes with their static schedule row."""
    src, out, ck = P.fresh_paths(spark, "enrich", "in", "out", "checkpoint")
    q = V.quotes(spark, sf_dir).select("quote_id", "contest_id", "book", "quote_at")
    P.write_in_order(q, src, "quote_at", EVENT_EDGES)
    static = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("contest_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("account"))
    return P.run_available(P.enrich(P.stream_files(spark, src, q.schema), static, "contest_id"), out, ck).select("quote_id", "book", "name", "account")


@query("stream_missed_alerts", "WITH " + V.CONTESTS + """
SELECT contest_id, decision_at AS cutoff, CAST(1 AS BIGINT) AS alerts FROM contests WHERE contest_id % 10 IN (3, 4, 6)""")
def stream_missed_alerts(spark, sf_dir):
    """One alert per contest whose window passed without a record (L6): cutoffs are announced on every poll; records are
    missing, late, too early, or in time. Nothing is alerted for windows still open."""
    cs, rs, out, ck = P.fresh_paths(spark, "alerts", "cutoffs", "records", "alerts", "checkpoint")
    c = V.contests(spark, sf_dir).select("contest_id", F.col("decision_at").cast("timestamp").alias("cutoff"))
    k = F.col("contest_id") % 10
    minutes = F.when(k == 4, 1).when(k == 6, -8).otherwise(-2).cast("int")
    r = c.where(k != 3).select("contest_id", (F.col("cutoff") + F.make_dt_interval(F.lit(0), F.lit(0), minutes)).alias("recorded_at"))
    open_ = c.limit(0).unionByName(spark.createDataFrame([(-1, "2150-01-01 00:00:00")], "contest_id bigint, cutoff string")
                                   .withColumn("cutoff", F.col("cutoff").cast("timestamp")))
    P.write_in_order(c.unionByName(c).unionByName(open_), cs, "cutoff", CONTEST_EDGES)
    P.write_in_order(r, rs, "recorded_at", CONTEST_EDGES)
    beat = spark.createDataFrame([(None, "2100-01-01 00:00:00")], "contest_id bigint, recorded_at string")
    append(beat.withColumn("recorded_at", F.col("recorded_at").cast("timestamp")), rs)
    got = P.run_available(P.missed_windows(P.stream_files(spark, cs, c.schema), P.stream_files(spark, rs, r.schema)), out, ck)
    return got.groupBy("contest_id", F.col("cutoff").cast("timestamp_ntz").alias("cutoff")).agg(F.count("*").alias("alerts"))


@query("stream_new_files", "SELECT event_id AS row_id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END AS run FROM events")
def stream_new_files(spark, sf_dir):
    """A second run reads only the files that arrived since the first."""
    src, out, ck = P.fresh_paths(spark, "files", "in", "out", "checkpoint")
    e = V.table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"))
    for run, part in ((1, e.where("row_id % 2 = 0")), (2, e.where("row_id % 2 = 1"))):
        append(part, src)
        P.run_available(P.stream_files(spark, src, e.schema, per_trigger=100).withColumn("run", F.lit(run)), out, ck)
    return spark.read.parquet(out).select("row_id", "run")
