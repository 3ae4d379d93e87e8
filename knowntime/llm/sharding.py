"""Sharding by Hilbert order: rows near in several metadata columns share files, so range filters prune files.

Built-in expressions only. Every dimension is cut into equally full levels, the levels become one position on the
Hilbert curve (Hamilton's state walk, tables made from the rule), rows are sorted by it over all tasks, and equal runs
of that order become the shards.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from knowntime.llm.common import partitions, saved, whole_text


def curve_table(dims: int) -> list[int]:
    """Entry (state * 2^dims + corner) holds next state * 2^dims + step; a state is (entry corner, direction)."""
    size, mask = 1 << dims, (1 << dims) - 1

    def left(b: int, k: int) -> int:
        k %= dims
        return ((b << k) | (b >> (dims - k))) & mask

    def ones(b: int) -> int:          # trailing set bits
        return ((b ^ (b + 1)).bit_length() - 1) % dims

    gray = [i ^ (i >> 1) for i in range(size)]
    rank = {g: i for i, g in enumerate(gray)}
    out = []
    for direction in range(dims):
        for entry in range(size):
            for corner in range(size):
                step = rank[left(corner ^ entry, dims - (direction + 1) % dims)]
                start = gray[2 * ((step - 1) // 2)] if step else 0
                turn = 0 if step == 0 else ones(step - 1) if step % 2 == 0 else ones(step)
                state = ((direction + turn + 1) % dims) * size + (entry ^ left(start, direction + 1))
                out.append(state * size + step)
    return out


def hilbert_index(levels: Sequence[Column], bits: int) -> Column:
    """Position on the Hilbert curve of a cell given by its level in each dimension (0 to 2^bits - 1)."""
    dims = len(levels)
    size = 1 << dims
    steps = F.array(*map(F.lit, curve_table(dims)))

    def corner(i: Column) -> Column:
        bit = [F.call_function("shiftright", x.cast("int"), i).bitwiseAND(F.lit(1)) * (1 << j) for j, x in enumerate(levels)]
        return reduce(lambda a, b: a + b, bit)

    def walk(acc: Column, i: Column) -> Column:
        code = F.element_at(steps, acc["state"] * size + corner(i) + 1)
        return F.struct((code / size).cast("int").alias("state"), (acc["h"] * size + code % size).alias("h"))

    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("h"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, walk, lambda acc: acc["h"])


def text_cuts(df: DataFrame, column: str, bits: int) -> list[str]:
    """Values that begin a level: whole strings in order, cut so that each of up to 2^bits levels has about as many rows.

    Rows are counted per value, values are numbered by running sums inside range partitions; at most 2^bits values reach the
    driver. A value that fills several levels begins one.
    """
    levels = 1 << bits
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    ordered = saved(counts.repartitionByRange(partitions(df), "value").withColumn("_part", F.spark_partition_id()), "values")
    upto = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)      # one row per range partition
    whole = W.orderBy("_part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    starts = ordered.groupBy("_part").agg(F.sum("n").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start"), F.sum("_n").over(whole).alias("_total"))
    inside = F.sum("n").over(W.partitionBy("_part").orderBy("value").rowsBetween(W.unboundedPreceding, -1))
    placed = ordered.withColumn("_before", F.coalesce(inside, F.lit(0))).join(starts, "_part").select(
        "value", F.expr(f"((_start + _before) * {levels}) div _total").alias("level"))
    return sorted(r["value"] for r in placed.groupBy("level").agg(F.min("value").alias("value")).collect())


def text_level(value: Column, cuts: Sequence[str]) -> Column:
    """How many cuts but the first lie at or below the value; 0 for null."""
    return F.coalesce(F.size(F.filter(F.array(*[F.lit(c) for c in cuts[1:]]), lambda c: c <= value)), F.lit(0)) if len(cuts) > 1 else F.lit(0)


def level_bounds(df: DataFrame, codes: Sequence[Column], bits: int) -> list[list[int]]:
    """For each dimension, 2^bits - 1 cuts that leave about as many rows in each level. One pass over the named columns;
    (2^bits - 1) numbers per dimension reach the driver, whatever the size."""
    cuts = [i / (1 << bits) for i in range(1, 1 << bits)]
    row = df.agg(*[F.percentile_approx(c, cuts, 10_000).alias(f"d{i}") for i, c in enumerate(codes)]).first()
    return [list(x) if x else [] for x in row]


def level(code: Column, bounds: Sequence[int]) -> Column:
    """How many different cuts lie at or below the value."""
    cut = F.array(*[F.lit(int(b)).cast("long") for b in sorted(set(bounds))])
    return F.size(F.filter(cut, lambda b: b <= code)) if bounds else F.lit(0)


def global_rank(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Rows with ``_rank`` (0, 1, ... over the whole table in the order of ``keys``) and ``_total``.

    Range partitions are sorted on their own and numbered from their sizes, so no task sees more than its range. Keys
    should tell rows apart; then a value that fills a third of the rows is cut up as well. Equal rows may swap ranks.
    """
    n = partitions(df)
    ordered = saved(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                    .withColumn("_at", F.monotonically_increasing_id()), name)
    at = ordered.withColumn("_part", F.shiftright("_at", 33)).withColumn("_no", F.col("_at") - F.shiftleft("_part", 33))
    sizes = at.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))       # one row per range partition
    upto = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    whole = W.orderBy("_part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start"), F.sum("_n").over(whole).alias("_total"))
    return at.join(starts, "_part").withColumn("_rank", F.col("_start") + F.col("_no")).drop("_part", "_no", "_at", "_start")


def shard_documents(docs: DataFrame, shards: int = 40, bits: int = 5) -> DataFrame:
    """Cut documents (doc_id, text, lang, source) into ``shards`` runs of the Hilbert order over source, lang and length.

    Law ``rows``: shard sizes differ by one row at most. Returns doc_id, lang, source, size (UTF-8 bytes + 16),
    text_crc32, cell (curve position), shard and slot (gapless from 0 in each shard). Null text counts as empty, null
    metadata sorts first, equal texts of one cell stand together, an empty table gives an empty result.
    """
    text = whole_text()
    rows = docs.select("doc_id", "lang", "source", (F.octet_length(text).cast("long") + 16).alias("size"),
                       F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("_hash"))
    sizes, = level_bounds(docs.select((F.octet_length(text).cast("long") + 16).alias("size")), [F.col("size")], bits)
    by_text = [text_level(F.when(F.col(c).isNotNull(), F.col(c)), text_cuts(docs.select(c), c, bits)) for c in ("source", "lang")]
    cell = hilbert_index([*by_text, level(F.col("size"), sizes)], bits)
    ranked = global_rank(rows.withColumn("cell", cell), ["cell", "_hash", "doc_id", "source", "lang"], "shards")
    shard = F.expr(f"(_rank * {shards}) div _total")
    return (ranked.withColumn("shard", shard)
            .withColumn("slot", F.expr(f"_rank - ((shard * _total + {shards - 1}) div {shards})"))
            .withColumn("shard", F.col("shard").cast("int")).drop("_hash", "_rank", "_total"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order, so that file statistics cover small ranges of every dimension."""
    (sharded.repartition(F.col("shard")).sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
