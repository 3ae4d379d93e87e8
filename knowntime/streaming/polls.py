"""Structured Streaming forms of the polling jobs: each is a plain streaming DataFrame or sink."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from knowntime.sources.tables import append
from knowntime.session import scratch_path


#: Files that a slice of arriving data is written as, and read in one micro-batch.
SLICE_FILES = 4


def stream_files(spark: SparkSession, path: str, schema: T.StructType, *, per_trigger: int = SLICE_FILES) -> DataFrame:
    """New files of a folder, oldest first; the checkpoint remembers what was read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


@contextmanager
def stream_settings(spark: SparkSession, count: int | None = None, *, map_state: bool = False):
    """What a new stream fixes when it first starts, restored afterwards: its number of state partitions (one per core by default
    instead of the batch setting), and with ``map_state`` the state store that timers and keyed states need."""
    wanted = {"spark.sql.shuffle.partitions": str(count or spark.sparkContext.defaultParallelism)}
    if map_state:
        wanted["spark.sql.streaming.stateStore.providerClass"] = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def run_available(stream: DataFrame, path: str, checkpoint: str, *, mode: str = "append", map_state: bool = False,
                  late: list[int] | None = None) -> DataFrame:
    """Process everything that is there now into a parquet table, then stop; returns the table.

    ``late``: a list to which the number of rows is added that came after the watermark had passed them.
    """
    spark = stream.sparkSession
    with stream_settings(spark, map_state=map_state):
        q = (stream.writeStream.format("parquet").outputMode(mode).option("path", path)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        q.awaitTermination()
    if late is not None:
        late.append(sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"]))
    return spark.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, handle, checkpoint: str) -> None:
    """Hand every micro-batch to ``handle(batch, batch_id)`` until nothing is left."""
    q = (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def served_once(polls: DataFrame, *, delay: str = "1 hour") -> DataFrame:
    """A cutoff is served by its first poll; repeats within the delay are dropped."""
    return polls.withWatermark("polled_at", delay).dropDuplicatesWithinWatermark(["cutoff"])


def refuse_late(issue_time: str = "issued_at", cutoff: str = "decision_at") -> Column:
    """True when the calculation crossed its cutoff: nothing may be issued or backdated."""
    return F.col(issue_time) > F.col(cutoff)


def write_batch(batch: DataFrame, path: str, batch_id: int) -> None:
    """A micro-batch's rows in a folder of its own: writing the batch again replaces them."""
    batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def late_writer(issued_path: str, late_path: str):
    """Sink of two tables: forecasts in time go to one, late ones to the other, never both. A batch that is tried again,
    wherever it had failed, leaves each row once."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch.where(~refuse_late()), issued_path, batch_id)
        write_batch(batch.where(refuse_late() | refuse_late().isNull()), late_path, batch_id)
    return handle


def split_late(forecasts: DataFrame, issued_path: str, late_path: str, checkpoint: str) -> None:
    """Run ``late_writer`` over a stream; a forecast without a time is not in time."""
    run_batches(forecasts, late_writer(issued_path, late_path), checkpoint)


def fresh_quotes(decisions: DataFrame, quotes: DataFrame, *, max_age: str = "10 minutes",
                 delay: str = "10 minutes") -> DataFrame:
    """Quotes no older than ``max_age`` at a decision: an interval join of two streams.

    Both sides have watermarks, so the join keeps only ``max_age`` of quotes in its state.
    """
    d = decisions.withWatermark("decision_at", delay).alias("d")
    q = quotes.withWatermark("available_at", delay).alias("q")
    on = F.expr(f"d.contest_id = q.contest_id AND q.available_at <= d.decision_at "
                f"AND q.available_at >= d.decision_at - INTERVAL {max_age}")
    return d.join(q, on).select("d.contest_id", "d.decision_at", "q.book", "q.quote_id", "q.available_at")


def enrich(stream: DataFrame, schedule: DataFrame, key: str) -> DataFrame:
    """Streaming rows with the static schedule they belong to."""
    return stream.join(schedule, key)


def missed_windows(cutoffs: DataFrame, records: DataFrame, *, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """One alert per (contest_id, cutoff) whose window before the cutoff passed without a record.

    Both are streams: cutoffs may be announced again and again, records are (contest_id, recorded_at). The outer join holds a cutoff until the watermark
    is past it, so nothing is alerted early; announcements after that are late and dropped. Time goes on with
    ``recorded_at``, also of heartbeats: rows without a contest.
    """
    # A key that is never null: an optimizer's filter on nulls would keep the heartbeats from the watermark.
    key = F.coalesce(F.concat(F.lit("of "), F.col("contest_id").cast("string")), F.lit("heartbeat")).alias("key")
    c = (cutoffs.where("contest_id IS NOT NULL").select("contest_id", "cutoff", key).withWatermark("cutoff", delay)
         .dropDuplicates(["contest_id", "cutoff"]).alias("c"))
    r = records.select(key, "recorded_at").withWatermark("recorded_at", delay).alias("r")
    on = F.expr(f"c.key = r.key AND r.recorded_at <= c.cutoff AND r.recorded_at >= c.cutoff - INTERVAL {window}")
    return c.join(r, on, "left_outer").where("r.key IS NULL").select("c.contest_id", "c.cutoff")


def write_in_order(frame: DataFrame, path: str, time: str, edges, *, files: int = SLICE_FILES) -> None:
    """Write a table as slices that follow one another in time, each of ``files`` files (stand-in for arriving data)."""
    bounds = [None, *edges, None]
    for low, high in zip(bounds, bounds[1:]):
        part = frame
        if low:
            part = part.where(F.col(time) >= F.lit(low).cast(frame.schema[time].dataType))
        if high:
            part = part.where(F.col(time) < F.lit(high).cast(frame.schema[time].dataType))
        append(part.repartition(files), path)


def fresh_paths(spark: SparkSession, name: str, *parts: str) -> list[str]:
    root = scratch_path(spark, name)
    return [f"{root}/{p}" for p in parts]
