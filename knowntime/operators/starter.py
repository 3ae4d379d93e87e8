"""Expected participants: who started last, how they did, and whether they are a stand-in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from knowntime.functions.times import DAY_US, as_micros, micros
from knowntime.operators.asof import CHUNK_DAYS, asof_cumulative, asof_rolling
from knowntime.session import scratch_path

#: Fixed value: length of the stretches by which starts are dealt.
SLOT_DAYS = 28


def weekly_primary(weekly: DataFrame) -> DataFrame:
    """The player with most attempts per (season, week, team); equal attempts: lowest id."""
    best = F.max_by(F.struct("player_id", "epa"), F.struct("attempts", -F.col("player_id")))
    return weekly.groupBy("season", "week", "team").agg(best.alias("_b")).select(
        "season", "week", "team", F.col("_b.player_id").alias("primary_id"),
        F.coalesce("_b.epa", F.lit(0.0)).alias("primary_epa"))


def actual_starts(sides: DataFrame, primary: DataFrame) -> DataFrame:
    """Starts of settled contests: the recorded starter, else the week's primary.

    A week's EPA counts only when its primary is the starter. ``seq`` orders the two sides of
    a contest.
    """
    j = sides.join(primary, ["season", "week", "team"], "left")
    starter = F.coalesce("starter_id", "primary_id")
    return (j.withColumn("starter", starter).where("starter IS NOT NULL")
            .withColumn("epa", F.when(F.col("primary_id") == F.col("starter"), F.col("primary_epa")))
            .withColumn("seq", F.when(F.col("side") == "home", 0).otherwise(1))
            .select("contest_id", "team", "available_at", "seq", "starter", "epa"))


def expected_starter(starts: DataFrame, probes: DataFrame, *, window: int = 8,
                     chunk_days: float | None = CHUNK_DAYS) -> DataFrame:
    """Per contest and side: mean EPA, start count, unknown and backup flags.

    The expected starter is the one of the team's latest visible contest. A backup differs
    from the team's most used starter; equal use goes to whoever started first. Counts only
    grow, so "most used so far" is a running maximum of (count, earliest first start).

    What a probe sees depends on its key and instant alone. So starts are summed up per instant and written once
    (to ``spark.checkpoint.dir``, while the query is built), instants are looked up once each, and windows run over
    instants, however many contests share them. The two passes over all rows deal them over all shuffle partitions, which
    Spark then leaves apart: merged by their compressed bytes they would take many times as much memory in one task.
    """
    kw = {"fact_time": "available_at", "probe_time": "decision_at", "chunk_days": chunk_days}
    parts = int(starts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_instant = _instant_starts(starts, window, parts)
    asked = probes.where("team IS NOT NULL AND decision_at IS NOT NULL")

    # The latest start and the most used starter are two running maxima of one pass over the team's instants.
    ranked = _team_starts(by_instant.where("_rn = 1 AND team IS NOT NULL"))
    lead = F.struct(F.col("uses"), (-micros("_first.available_at")).alias("t"),
                    (-F.col("_first.contest_id")).alias("c"), (-F.col("_first.seq")).alias("s"), F.col("starter"))
    latest = F.struct("_last", "starter")
    seen = ranked.groupBy("team", "available_at").agg(F.max(latest).alias("_l"), F.max(lead).alias("_u"))
    team = asof_cumulative(seen, asked.select("team", "decision_at").distinct(), ["team"],
                           maxima={"_latest": F.struct("available_at", "_l"), "_lead": F.col("_u")}, **kw)
    team = team.select("team", "decision_at", F.col("_latest._l.starter").alias("expected"), F.col("_lead.starter").alias("_most"))

    own = by_instant.withColumn("expected", F.col("starter"))
    newest = Window.partitionBy("expected", "_slot", "available_at").orderBy(F.desc("contest_id"), F.desc("seq"))
    kept = (own.where("epa IS NOT NULL").select("expected", "_slot", "available_at", "contest_id", "seq", "epa")
            .withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= window)
            .select("expected", "available_at", "contest_id", "seq", "epa"))
    count = own.where("_rn = 1").groupBy("expected", "available_at").agg(F.sum("_n").alias("_n"))
    by = asof_rolling(kept, team.where("expected IS NOT NULL").select("expected", "decision_at").distinct(), ["expected"],
                      order=["contest_id", "seq"], window=window, measures=["epa"], aggs={"mean_epa": F.avg("epa")}, **kw)
    by = asof_cumulative(count, by, ["expected"], sums={"starts": F.col("_n")}, **kw)

    known = F.col("mean_epa").isNotNull()
    found = team.join(by, ["expected", "decision_at"], "left").select(
        "team", "decision_at", F.when(known, F.col("mean_epa")).otherwise(0.0).alias("epa"),
        F.when(known, F.col("starts")).otherwise(0).cast("double").alias("starts"), (~known).cast("double").alias("unknown"),
        (known & (F.col("expected") != F.col("_most"))).cast("double").alias("backup"))
    out = asked.repartition(parts, "team", "decision_at").join(found, ["team", "decision_at"], "left")
    # A probe without a team or time sees nothing.
    cold = probes.where("team IS NULL OR decision_at IS NULL").select(
        "*", F.lit(0.0).alias("epa"), F.lit(0.0).alias("starts"), F.lit(1.0).alias("unknown"), F.lit(0.0).alias("backup"))
    return out.select(cold.columns).unionByName(cold)


def _instant_starts(starts: DataFrame, window: int, parts: int) -> DataFrame:
    """Of every team, starter and instant the last ``window`` starts with an EPA (at least one row, ``_rn`` = 1), beside the
    number ``_n`` of all its starts and their ends ``_one`` and ``_last`` (contest_id, seq)."""
    spark = starts.sparkSession
    key = ["team", "starter", "_slot"]
    dealt = (starts.where("starter IS NOT NULL AND available_at IS NOT NULL")
             .select("team", "starter", "available_at", "contest_id", "seq", "epa",
                     F.floor(as_micros(starts, "available_at") / F.lit(SLOT_DAYS * DAY_US)).cast("bigint").alias("_slot"))
             .repartition(parts, *key))
    instant = Window.partitionBy(*key, "available_at")
    # Only the last ``window`` with an EPA can enter a mean.
    newest = instant.orderBy(F.col("epa").isNull(), F.desc("contest_id"), F.desc("seq"))
    place = F.struct("contest_id", "seq")
    rows = dealt.withColumn("_rn", F.row_number().over(newest)).select(
        "*", F.count("*").over(instant).alias("_n"), F.min(place).over(instant).alias("_one"), F.max(place).over(instant).alias("_last"))
    path = scratch_path(spark, "starts")
    rows.where((F.col("_rn") == 1) | (F.col("_rn") <= window) & F.col("epa").isNotNull()).write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _team_starts(at: DataFrame) -> DataFrame:
    """Per team, starter and instant: ``_last`` start (contest_id, seq), ``uses`` up to then and the starter's ``_first`` start of all."""
    key = ["team", "starter", "_slot"]
    whole = Window.partitionBy("team", "starter")
    so_far = whole.orderBy("_slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.min(F.struct("available_at", "_one.contest_id", "_one.seq"))
    before = at.groupBy(*key).agg(F.sum("_n").alias("_k"), first.alias("_f")).select(
        *key, (F.sum("_k").over(so_far) - F.col("_k")).alias("_off"), F.min("_f").over(whole).alias("_first"))
    inside = Window.partitionBy(*key).orderBy("available_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (at.withColumn("_in", F.sum("_n").over(inside)).join(before, key)
            .select("team", "starter", "available_at", "_last", "_first", (F.col("_off") + F.col("_in")).alias("uses")))
