"""Block bootstrap: only block sums are resampled, never rows.

Draws come from a hash of (seed, repetition, slot), so every engine, cluster size and retry
gives the same interval. A group's blocks are calendar weeks (or longer), so their number, and
the array of sums each repetition carries, is bounded by the calendar and not by the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from knowntime.functions.times import DAY_US, micros


def relative_weeks(frame: DataFrame, keys: Sequence[str], time: str = "decision_at") -> DataFrame:
    """Add ``block``: whole weeks since the group's first decision."""
    first = frame.groupBy(*keys).agg(F.min(time).alias("_first"))
    week = F.floor(F.floor((micros(time) - micros("_first")) / F.lit(DAY_US)) / 7)
    return frame.join(first, list(keys)).withColumn("block", week.cast("bigint")).drop("_first")


def season_week(season: str = "season", time: str = "decision_at") -> Column:
    """One block per season and ISO week."""
    return F.concat_ws("-", F.col(season).cast("string"), F.weekofyear(time).cast("string"))


def block_sums(frame: DataFrame, keys: Sequence[str], value: Column, block: str = "block") -> DataFrame:
    return frame.groupBy(*keys, block).agg(F.sum(value).alias("s"), F.count("*").alias("n"))


def draw(seed: int, rep: Column, slot: Column, blocks: Column) -> Column:
    """A block number in ``0..blocks-1`` from the hash of (seed, repetition, slot)."""
    text = F.concat(F.lit(f"{seed}|"), rep.cast("string"), F.lit("|"), slot.cast("string"))
    return F.conv(F.substr(F.md5(text), F.lit(1), F.lit(8)), 16, 10).cast("bigint") % blocks


def bootstrap_interval(sums: DataFrame, keys: Sequence[str], *, reps: int = 1000, seed: int = 42,
                       min_blocks: int = 0, block: str = "block") -> DataFrame:
    """Mean, 95 % interval and block count per group; no interval below ``min_blocks``."""
    keys = list(keys)
    total = sums.groupBy(*keys).agg(
        F.count("*").alias("blocks"), (F.sum("s") / F.sum("n")).alias("difference"),
        F.sort_array(F.collect_list(F.struct(block, "s", "n"))).alias("_sums"))
    # One row per repetition; each draws its own resample from the array of block sums.
    runs = (total.where(F.col("blocks") >= min_blocks)
            .withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
            .repartition(sums.sparkSession.sparkContext.defaultParallelism, *keys, "_rep"))
    picks = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda slot: F.get(
        "_sums", draw(seed, F.col("_rep"), slot, F.col("blocks")).cast("int")))
    means = runs.select(*keys, picks.alias("_p")).select(*keys, (
        F.aggregate("_p", F.lit(0.0), lambda a, x: a + x["s"])
        / F.aggregate("_p", F.lit(0).cast("bigint"), lambda a, x: a + x["n"])).alias("_mean"))
    ends = means.groupBy(*keys).agg(F.expr("percentile(_mean, 0.025D)").alias("low"),
                                    F.expr("percentile(_mean, 0.975D)").alias("high"))
    return total.drop("_sums").join(ends, keys, "left")
