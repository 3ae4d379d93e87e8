"""Connected components as joins and aggregates: alternating large-star and small-star rounds until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowntime.llm.common import saved


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node ties its larger neighbours to its least neighbour (or itself)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node ties itself and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return (down.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b"))))


def connected_components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """Components of undirected edges (a, b) of any one orderable type.

    Returns (node, component) for every node of an edge between different nodes; component is the least node reachable.
    Loops, repeats and nulls are ignored, no edges give no rows. Each round is written to the shared folder; only its row
    count and checksum reach the driver. The least neighbour is aggregated before the shuffle, so a hub with millions of
    edges costs one row per task there; its edges are a plain join that adaptive execution splits.
    """
    now = saved(edges.where("a is not null and b is not null and a <> b")
                .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    before = None
    for _ in range(rounds):
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if mark == before or mark[0] == 0:
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = mark
        now = saved(_small_star(_large_star(now).distinct()).distinct(), "components")
    raise RuntimeError(f"components not settled after {rounds} rounds")
