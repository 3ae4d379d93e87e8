"""Versions of a schedule, incremental facts and the settlement of recorded forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def schedule_changes(current: DataFrame, incoming: DataFrame, *, time: str = "scheduled_at") -> DataFrame:
    """added / withdrawn / revised / unchanged per game, with the time before and after."""
    j = current.select("game_id", F.col(time).alias("before")).join(
        incoming.select("game_id", F.col(time).alias("after")), "game_id", "full_outer")
    return j.withColumn("change", F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "withdrawn")
                        .when(F.col("before") != F.col("after"), "revised").otherwise("unchanged"))


def merge_times_only(current: DataFrame, incoming: DataFrame,
                     times: Sequence[str] = ("scheduled_at", "decision_at")) -> DataFrame:
    """Incoming game set and times; a known game keeps its other columns as they were."""
    rest = [c for c in current.columns if c != "game_id" and c not in times]
    old = current.select("game_id", F.struct(*rest).alias("_old"))
    new = incoming.select("game_id", *times, F.struct(*rest).alias("_new"))
    kept = F.coalesce("_old", "_new")
    return (new.join(old, "game_id", "left").withColumn("_k", kept)
            .select("game_id", *times, *[F.col(f"_k.{c}").alias(c) for c in rest]))


def merge_facts(base: DataFrame, new: DataFrame, key: str = "game_id") -> DataFrame:
    """Base rows plus new keys only; merging the same facts twice changes nothing."""
    fresh = new.join(base.select(key), key, "left_anti")
    return base.unionByName(fresh.select(*base.columns))


def settle_records(records: DataFrame, schedule: DataFrame, results: DataFrame) -> DataFrame:
    """Outcome of every recorded forecast: void, pending or settled (a tie is a push)."""
    known = schedule.select("game_id").withColumn("_in", F.lit(True))
    j = records.join(known, "game_id", "left").join(results.select("game_id", "home_score", "away_score"), "game_id", "left")
    margin = F.col("home_score") - F.col("away_score")
    status = F.when(F.col("_in").isNull(), "void").when(margin.isNull(), "pending").otherwise("settled")
    outcome = F.when(margin > 0, "home").when(margin < 0, "away").when(margin == 0, "tie")
    settled = F.col("status") == "settled"
    return (j.withColumn("status", status).withColumn("outcome", F.when(settled, outcome))
            .withColumn("moneyline", F.when(settled, F.when(margin == 0, "push").otherwise("win_or_lose")))
            .drop("_in", "home_score", "away_score"))


def set_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side: empty when the two id sets are equal."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return (a.join(b, key, "left_anti").withColumn("only_in", F.lit("left"))
            .unionByName(b.join(a, key, "left_anti").withColumn("only_in", F.lit("right"))))
