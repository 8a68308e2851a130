"""Structured Streaming forms of the tables that grow: corrections, bundles, chunks."""

from __future__ import annotations

import contextlib
import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.lineage import materialize
from ..operators.ranking import top_per_group


def _timed(rows: DataFrame, delay: str) -> DataFrame:
    """Rows with a watermark when they stream; event time may be stored without a zone."""
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", delay) if rows.isStreaming else rows


def finetuning_counts(corrections: DataFrame, threshold: int = 50, delay: str = "1 day", window: str | None = None) -> DataFrame:
    """Flags per case on a stream (or a table), with ``triggered`` once the threshold is met.

    Without ``window`` the state is one counter per case and lives on; with it the
    counters of windows past the watermark are dropped.
    """
    rows = _timed(corrections, delay)
    keys = [F.col("case_id")] if window is None else [F.window("ts", window), F.col("case_id")]
    n = F.count_if(F.col("correction_type") == "flag_for_finetuning")
    return rows.groupBy(*keys).agg(n.alias("flagged"), (n >= threshold).alias("triggered"))


def qc_windows(bundles: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Status counts per tumbling window and source; the same on a table and on a stream."""
    rows = _timed(bundles, delay)
    s = F.col("qc_status")
    out = rows.groupBy(F.window("ts", window).alias("w"), "source").agg(
        F.count("*").alias("total_bundles"), F.count_if(s == "ok").alias("passed"), F.count_if(s == "warning").alias("warned"), F.count_if(s == "fail").alias("failed"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "source", "total_bundles", "passed", "warned", "failed")


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished rows to a parquet table and stop when the input is used up."""
    return (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def log_batches(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what each micro-batch gives, one folder per batch, so that a repeated batch writes its own anew."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def log_triggers(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Log each state of a case at or above the threshold, with its micro-batch.

    A repeated batch rewrites its own folder, so a restart adds nothing twice.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.filter("triggered").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return counts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()


@contextlib.contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, on disk instead of in the heap."""
    key, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key)
    spark.conf.set(key, provider)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class _FireOnce(StatefulProcessor):
    """Counts the flags of a case; gives one row when the count first reaches the threshold."""

    def __init__(self, threshold: int, flag: str, quiet_ms: int | None, ttl_ms: int | None):
        self.threshold, self.flag, self.quiet_ms, self.ttl_ms = threshold, flag, quiet_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "flagged long, fired boolean, last long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        flagged, fired, last = self.seen.get() or (0, False, -1)
        need, before = self.threshold - flagged, last
        first: list[tuple] = []  # the earliest flags of this batch, no more than a few times what is needed
        for row in rows:
            if row.ms is not None:
                last = max(last, row.ms)
            if row.correction_type != self.flag:
                continue
            flagged += 1
            if not fired:
                first.append((row.ts is None, row.ts, row.correction_id is None, row.correction_id))
                if len(first) > 4 * need:
                    first = heapq.nsmallest(need, first)
        fires = not fired and flagged >= self.threshold
        if self.quiet_ms is not None and last > before:
            if before >= 0:
                self.handle.deleteTimer(before + self.quiet_ms)
            self.handle.registerTimer(last + self.quiet_ms)
        self.seen.update((flagged, fired or fires, last))
        if fires:
            _, ts, _, correction = heapq.nsmallest(need, first)[-1]
            yield Row(case_id=key[0], correction_id=correction, ts=ts, threshold=self.threshold)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.seen.clear()  # a case that was quiet for so long starts anew
        return iter(())


TRIGGER_SCHEMA = "case_id string, correction_id string, ts timestamp, threshold long"


def fire_once(corrections: DataFrame, threshold: int = 50, flag: str = "flag_for_finetuning", quiet: str | None = None, ttl: str | None = None, delay: str = "1 day") -> DataFrame:
    """One row ``(case_id, correction_id, ts, threshold)`` per case, at the flag that reaches the threshold.

    A stream operator over ``corrections(case_id, correction_id, correction_type, ts)``. The
    state of a case is one counter and whether it has fired, so later flags, later
    micro-batches and restarts from the checkpoint add no second row. Inside a micro-batch flags
    count in the order of ``ts`` and ``correction_id``; at most ``threshold`` of them are held.
    With ``quiet`` a case starts anew once the watermark is that far past its last row (a timer
    on event time; rows later than the watermark are dropped). With ``ttl`` the state
    of a case goes that long after its last change, by the clock; such a query runs until it is
    stopped. Start it inside ``rocksdb_state``.
    """
    if quiet and ttl:
        raise ValueError("timers run on event time, the time to live by the clock: choose one")
    ms = lambda text: int(pd.Timedelta(text) / pd.Timedelta(milliseconds=1)) if text else None
    rows = corrections.select("case_id", "correction_id", "correction_type", F.col("ts").cast("timestamp").alias("ts"))
    if not quiet and not ttl:
        rows = rows.where(F.col("correction_type") == flag)  # other rows change no state
    mode = "EventTime" if quiet else "ProcessingTime" if ttl else "None"
    if quiet:
        rows = rows.withWatermark("ts", delay)
    rows = rows.withColumn("ms", F.unix_millis("ts"))
    return rows.groupBy("case_id").transformWithState(_FireOnce(threshold, flag, ms(quiet), ms(ttl)), TRIGGER_SCHEMA, "Append", mode)


def late_rows(rows: DataFrame, closed: DataFrame, window: str = "1 day") -> DataFrame:
    """``(window_start, source, late_rows)`` for closed windows: rows that came after their window had closed.

    ``rows`` is all that arrived, as a table; ``closed`` what ``qc_windows`` wrote. Rows of a
    window and source that were all late have no closed row; they are told as well once
    any source of the window, or a later window, is closed.
    """
    horizon = closed.agg(F.max("window_end")).scalar()
    came = qc_windows(rows, window).where(F.col("window_end") <= horizon).select("window_start", "source", F.col("total_bundles").alias("_came"))
    counted = closed.select("window_start", "source", F.col("total_bundles").alias("_counted"))
    return came.join(counted, ["window_start", "source"], "left").select("window_start", "source", (F.col("_came") - F.coalesce("_counted", F.lit(0))).alias("late_rows"))


def _exists(spark: SparkSession, path: str) -> bool:
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(name)


def _remove(spark: SparkSession, path: str) -> None:
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(name, True)


def merge_batch(batch: DataFrame, path: str, batch_id: int, key: str = "point_id", version: str = "version", buckets: int = 64) -> None:
    """Merge one batch of versions into a table partitioned by the hash bucket of its key.

    Only buckets that the batch touches are read and written. The merged buckets are first
    written beside the table, then put in their places by a dynamic partition overwrite; if the
    driver is lost in between, the repeated batch finds them complete and only puts them in place,
    so no row of a half-replaced bucket is lost. Of equal versions the later batch wins,
    inside a batch the larger row. ``buckets`` must stay as it is for the life of the
    table; choose it so that a bucket fits a task.
    """
    spark = batch.sparkSession
    ready = f"{path}-merge/batch={batch_id}"
    if not _exists(spark, f"{ready}/_SUCCESS"):
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        rows = materialize(rows)
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # no more than there are buckets
        fresh = rows.withColumn("_fresh", F.lit(1))
        if _exists(spark, path):
            kept = spark.read.schema(rows.schema).parquet(path).where(F.col("bucket").isin(touched)).withColumn("_fresh", F.lit(0))
            fresh = fresh.unionByName(kept)
        others = [F.desc(c) for c in batch.columns if c not in (key, version)]
        last = top_per_group(fresh, [key], [F.desc(version), F.desc("_fresh"), *others], 1).drop("_fresh")
        last.write.mode("overwrite").parquet(ready)
    merged = spark.read.parquet(ready)
    if not merged.isEmpty():
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    _remove(spark, f"{path}-merge/batch={batch_id - 1}")


def merge_upserts(chunks: DataFrame, path: str, checkpoint: str, key: str = "point_id", version: str = "version", buckets: int = 64) -> StreamingQuery:
    """Keep a bucketed table of the last version per key; readers need no ranking over the history."""
    def write(batch: DataFrame, batch_id: int) -> None:
        merge_batch(batch, path, batch_id, key, version, buckets)
    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_points(spark: SparkSession, path: str) -> DataFrame:
    """The table as it is; a look-up by key prunes to one bucket with ``bucket = pmod(xxhash64(key), buckets)``."""
    return spark.read.parquet(path).drop("bucket")


def log_upserts(chunks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append chunk versions to a log, one folder per micro-batch; nothing old is rewritten."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_points(spark: SparkSession, path: str, key: str = "point_id", version: str = "version") -> DataFrame:
    """The upsert log as a table: last version of each point, later batches first on equal versions."""
    log = spark.read.parquet(path)
    return top_per_group(log, [key], [F.desc(version), F.desc("batch")], 1).drop("batch")


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Write the current points as a new log of one batch."""
    current_points(spark, path).write.mode("errorifexists").parquet(f"{target}/batch=0")
