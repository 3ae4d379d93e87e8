"""Files in and out: typed scans, write-once, append and insert-only sinks, fingerprints."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a declared schema (ids stay strings) and a header that must match it."""
    return (spark.read.option("header", True).option("enforceSchema", False)
            .option("mode", "FAILFAST").schema(schema).csv(path))


def read_json_arrays(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Many files (a glob), each one JSON array of records."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_snapshots(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Snapshot files of a folder with the name each row was filed under (``file_stem``): that of its JSON file, or of the folder ``stem=``
    that a distributed writer put it in."""
    folder = F.regexp_extract("_metadata.file_path", r"/stem=([^/]*)/[^/]*$", 1)
    file = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    return (spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path)
            .select("*", F.when(folder != "", folder).otherwise(file).alias("file_stem")))


def write_snapshots(snaps: DataFrame, path: str, id_column: str = "game_id", stem: Column | None = None) -> None:
    """One JSON file per snapshot, filed under the SHA-256 of its id (or ``stem``)."""
    named = F.sha2(F.col(id_column).cast("string"), 256) if stem is None else stem
    snaps.withColumn("stem", named).repartition("stem").write.partitionBy("stem").mode("append").json(path)


def check_snapshot_names(snaps: DataFrame, id_column: str = "game_id",
                         stem: str = "file_stem") -> DataFrame:
    """A snapshot must be filed under the SHA-256 of its id; adds ``name_ok``."""
    return snaps.withColumn("name_ok", F.sha2(F.col(id_column).cast("string"), 256) == F.col(stem))


def write_once(frame: DataFrame, path: str) -> None:
    """Fails when the output already exists."""
    frame.write.mode("errorifexists").parquet(path)


def append(frame: DataFrame, path: str) -> None:
    frame.write.mode("append").parquet(path)


def unseen(incoming: DataFrame, recorded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows whose key is not recorded yet, one per key (of several, the one whose other columns hash least)."""
    others = [c for c in incoming.columns if c not in keys]
    if not others:
        return incoming.distinct().join(recorded.select(*keys), list(keys), "left_anti")
    plain = [F.to_json(c) if "map<" in incoming.schema[c].dataType.simpleString() else F.col(c) for c in others]     # maps have no hash
    one = incoming.groupBy(*keys).agg(F.min_by(F.struct(*others), F.xxhash64(*plain)).alias("_row"))
    return (one.select(*keys, "_row.*").select(*incoming.columns)
            .join(recorded.select(*keys), list(keys), "left_anti").select(*incoming.columns))


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def claim(spark: SparkSession, path: str, note: str = "") -> bool:
    """Create ``path`` if nobody has: true for one caller only, whatever else fails afterwards.

    The file system decides (exclusive create), so this holds between clusters that share it.
    """
    fs, where = _file_system(spark, path)
    if fs.getScheme() == "file":                  # Hadoop's local file system looks first and creates then
        try:
            os.makedirs(os.path.dirname(where.toUri().getPath()), exist_ok=True)
            with open(where.toUri().getPath(), "x") as out:
                out.write(note)
            return True
        except FileExistsError:
            return False
    try:
        out = fs.create(where, False)
    except Exception as e:
        if "AlreadyExists" in str(e) or "already exists" in str(e):
            return False
        raise
    out.write(bytearray(note, "utf-8"))
    out.close()
    return True


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _file_system(spark, path)
    return bool(fs.exists(where))


@contextmanager
def only_writer(spark: SparkSession, path: str) -> Iterator[None]:
    """Hold the table at ``path`` alone; a second writer is refused meanwhile. A writer that died leaves ``<path>.writer``, which
    has to be looked at and removed by hand."""
    lock = path.rstrip("/") + ".writer"
    if not claim(spark, lock):
        raise RuntimeError(f"another writer holds {path}")
    try:
        yield
    finally:
        fs, where = _file_system(spark, lock)
        fs.delete(where, False)


def insert_only(spark: SparkSession, incoming: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Append only new keys to the table at ``path``, which is made if it is absent; running it again changes nothing."""
    with only_writer(spark, path):
        fresh = unseen(incoming, spark.read.parquet(path), keys) if exists(spark, path) else unseen(incoming, incoming.limit(0), keys)
        append(fresh, path)


def union_seasons(frames: Sequence[DataFrame]) -> DataFrame:
    """Concatenate seasons whose columns may differ."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def fingerprint(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Order-insensitive content fingerprint: rows, and sum and xor of per-row digests."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    d = F.conv(F.substr(F.md5(text), F.lit(1), F.lit(8)), 16, 10).cast("bigint")
    return frame.select(d.alias("_d")).agg(F.count("*").alias("rows"), F.sum("_d").alias("digest_sum"),
                                           F.bit_xor("_d").alias("digest_xor"))


def ingest_plan(sources: DataFrame, done: DataFrame, key: str, digest: str) -> DataFrame:
    """What to do with every source: skip what is done, refuse drift, parse the rest."""
    d = done.select(key, F.col(digest).alias("_before"))
    j = sources.join(d, key, "left")
    return j.withColumn("action", F.when(F.col("_before").isNull(), "parse")
                        .when(F.col("_before") == F.col(digest), "skip").otherwise("refuse")).drop("_before")


class Journal:
    """Resumable ingest into a folder: ``rows`` (what was parsed) and ``journal`` (what became of each source), both by run.

    A run's rows count once its journal is written, so a run that died is read by nobody and its sources are parsed again. A
    source that fails, or gives no row, is set aside with its reason and is not tried again by the same parser.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, parser_version: str):
        self.spark, self.path, self.key, self.version = spark, path.rstrip("/"), key, parser_version

    def sources(self) -> DataFrame | None:
        """Every source done or set aside so far; None before the first run."""
        at = f"{self.path}/journal"
        return self.spark.read.parquet(at) if exists(self.spark, at) else None

    def rows(self) -> DataFrame:
        """The rows of all finished runs."""
        runs = [r[0] for r in self.sources().select("run").distinct().collect()]     # one number per run
        return self.spark.read.option("basePath", f"{self.path}/rows").parquet(*[f"{self.path}/rows/run={n}" for n in sorted(runs)])

    def ingest(self, sources: DataFrame, digest: str, parse: Callable[[DataFrame], DataFrame]) -> int:
        """Parse what is new; returns the number of sources taken up.

        ``parse`` turns sources into (key, parsed array, reason): the rows of each, or why there are none. Sources whose ``digest``
        has changed since, or a changed parser, refuse the whole run before anything is written: use a new folder.
        """
        with only_writer(self.spark, self.path):
            before = self.sources()
            if before is not None:
                other = before.where(F.col("parser_version") != self.version).limit(1).count()
                plan = ingest_plan(sources, before, self.key, digest)
                drifted = plan.where("action = 'refuse'").count()
                if other or drifted:
                    raise ValueError(f"parser changed: {bool(other)}, changed sources: {drifted}; use a new folder")
                sources = plan.where("action = 'parse'").drop("action")
            run = 1 if before is None else before.agg(F.max("run")).first()[0] + 1
            got = parse(sources)
            reason = F.coalesce("reason", F.when(F.size("parsed") > 0, F.lit(None)).otherwise("no rows"))
            kept = f"{self.path}/rows/run={run}"
            got.select(self.key, "parsed", reason.alias("reason")).write.mode("overwrite").parquet(f"{self.path}/parsed/run={run}")
            got = self.spark.read.schema(got.select(self.key, "parsed", reason.alias("reason")).schema).parquet(f"{self.path}/parsed/run={run}")
            got.where("reason IS NULL").select(self.key, F.explode("parsed").alias("_row")).select(self.key, "_row.*").write.mode("overwrite").parquet(kept)
            entry = got.select(self.key, F.when(F.col("reason").isNull(), F.size("parsed")).otherwise(0).alias("n_rows"), "reason")
            taken = (sources.select(self.key, digest).join(entry, self.key)
                     .select("*", F.lit(self.version).alias("parser_version"), F.lit(run).alias("run")))
            n = entry.count()
            if n or before is None:
                append(taken, f"{self.path}/journal")
            return n
