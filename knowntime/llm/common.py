"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from knowntime.session import scratch_path

#: The six ASCII white-space characters that part words in every contract.
WHITE = " \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One of the given tables, with only the named columns read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


#: Lists that note the folders ``saved`` writes to.
_notes: list[list[str]] = []


@contextmanager
def noting(paths: list[str]) -> Iterator[None]:
    """Note every folder written meanwhile, for ``discard`` once its readers are done."""
    _notes.append(paths)
    try:
        yield
    finally:
        _notes.remove(paths)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete noted folders."""
    jvm = spark._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    paths.clear()


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, and lost executors lose nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    for notes in _notes:
        notes.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame) -> int:
    """How many partitions a shuffle makes; the cluster sizes it to its data."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def block_count(docs: DataFrame, size: int, column: str = "text") -> int:
    """How many blocks of about ``size`` bytes the texts make."""
    return max(1, -(-(docs.agg(F.sum(F.octet_length(column))).first()[0] or 0) // size))


def give_back() -> None:
    """Return what a task has freed to the system: workers live on, and the next stage needs the room."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def per_text(df: DataFrame, column: str, schema: str, fn: Callable[[list[str]], list[tuple]],
             drop: tuple[str, ...] = (), max_chars: int = 1 << 22, ended: Callable | None = None) -> DataFrame:
    """Append columns that ``fn`` computes from the texts of ``column`` (null counts as empty).

    ``fn`` gets runs of whole texts of about ``max_chars`` characters and returns one tuple for each; ``ended`` is called at a task's end.
    Columns of ``df`` that clash with the new names give way; those in ``drop`` are not carried on.
    """
    spark = df.sparkSession
    new = spark.createDataFrame([], schema).schema
    kept = [c for c in df.columns if c not in new.names and (c not in drop or c == column)]
    df = df.select(*kept)
    carried = [c for c in kept if c not in drop]
    out = df.select(*carried).schema
    for f in new.fields:
        out = out.add(f)
    new_arrow = to_arrow_schema(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            for lo, hi in slices(batch.column(at), max_chars):
                part = batch.slice(lo, hi - lo)
                rows = fn([t or "" for t in part.column(at).to_pylist()])
                cols = list(zip(*rows)) if rows else [()] * len(new_arrow)
                arrays = [part.column(part.schema.get_field_index(c)) for c in carried]
                arrays += [pa.array(v, f.type) for v, f in zip(cols, new_arrow)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*carried, *new.names])
        if ended:
            ended()
        give_back()

    return df.mapInArrow(run, out)


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts add up to about ``most`` bytes; one long text stands alone."""
    lo = total = 0
    for i, n in enumerate(pa.compute.binary_length(texts).to_pylist()):
        n = n or 0
        if i > lo and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(texts):
        yield lo, len(texts)


def whole_text(name: str = "text"):
    """The text, empty where it is null."""
    return F.coalesce(F.col(name), F.lit(""))
