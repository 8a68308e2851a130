"""Streams over several micro-batches: state that fires once, late rows, bucketed merges."""

import pytest
from pyspark.sql import functions as F

from stromalens.plans import retrieval_plans as R
from stromalens.streaming import streams

FLAGS = "case_id string, correction_id string, correction_type string, ts timestamp"


def _flags(spark, path, rows):
    """One file of (case, number, kind, minute)."""
    d = spark.createDataFrame(rows, "case_id string, n int, correction_type string, minute int")
    d = d.select("case_id", F.col("n").cast("string").alias("correction_id"), "correction_type", F.timestamp_seconds(F.col("minute") * 60).alias("ts"))
    d.coalesce(1).write.mode("append").parquet(path)


def _run(spark, tmp_path, **settings):
    source = spark.readStream.schema(FLAGS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with streams.rocksdb_state(spark):
        query = streams.log_batches(streams.fire_once(source, **settings), str(tmp_path / "log"), str(tmp_path / "state"))
    query.awaitTermination(30 if "ttl" in settings else None)  # by the clock there is always a batch to come
    query.stop()
    return sorted((r["case_id"], r["correction_id"]) for r in spark.read.parquet(str(tmp_path / "log")).collect())


def test_trigger_fires_once_and_survives_a_restart(spark, tmp_path):
    flag, other = "flag_for_finetuning", "reject"
    path = str(tmp_path / "in")
    # the third flag in time is the middle row of its file
    _flags(spark, path, [("a", 9, flag, 9), ("a", 1, flag, 1), ("b", 1, flag, 1), ("a", 2, other, 2)])
    _flags(spark, path, [("a", 14, flag, 14), ("a", 13, flag, 13), ("b", 2, flag, 2), (None, 1, flag, 3)])
    assert _run(spark, tmp_path, threshold=3) == [("a", "13")]
    _flags(spark, path, [("a", 20, flag, 20), ("b", 3, flag, 0), ("b", 4, flag, 4)])
    assert _run(spark, tmp_path, threshold=3) == [("a", "13"), ("b", "3")]
    assert _run(spark, tmp_path, threshold=3) == [("a", "13"), ("b", "3")]


def test_a_quiet_case_starts_anew(spark, tmp_path):
    flag, path = "flag_for_finetuning", str(tmp_path / "in")
    _flags(spark, path, [("a", 1, flag, 0), ("a", 2, flag, 1)])
    _flags(spark, path, [("b", 1, flag, 500)])  # the watermark passes a's last row by more than an hour
    _flags(spark, path, [("b", 2, flag, 501)])
    _flags(spark, path, [("a", 3, flag, 502)])
    _flags(spark, path, [("b", 3, flag, 503), ("a", 4, flag, 503), ("a", 5, flag, 504)])
    assert _run(spark, tmp_path, threshold=3, quiet="1 hour", delay="1 minute") == [("a", "5"), ("b", "3")]


def test_time_to_live_and_bad_settings(spark, tmp_path):
    flag, path = "flag_for_finetuning", str(tmp_path / "in")
    _flags(spark, path, [("a", 1, flag, 0), ("a", 2, flag, 1)])
    _flags(spark, path, [("a", 3, flag, 2)])
    assert _run(spark, tmp_path, threshold=3, ttl="1 hour") == [("a", "3")]
    with pytest.raises(ValueError):
        streams.fire_once(spark.readStream.schema(FLAGS).parquet(path), quiet="1 hour", ttl="1 hour")


def test_late_rows_are_counted(spark):
    d = R.stream_late_rows(spark, "/root/testdata/sf0.001")
    assert d.agg(F.sum("late_rows")).first()[0] > 5 and d.where("late_rows < 0").count() == 0


def test_merge_touches_only_its_buckets_and_repeats_safely(spark, tmp_path):
    path = str(tmp_path / "table")
    schema = "point_id string, version int, text string"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    streams.merge_batch(frame([(f"p{i}", 1, "a") for i in range(40)] + [("p0", 3, "x"), ("p0", 3, "y"), (None, 1, "n")]), path, 0, buckets=8)
    before = {r[0] for r in spark.read.parquet(path).select(F.input_file_name()).distinct().collect()}
    second = frame([("p1", 1, "again"), ("p2", 0, "old"), ("p2", 2, "new")])
    streams.merge_batch(second, path, 1, buckets=8)
    now = {r[0] for r in spark.read.parquet(path).select(F.input_file_name()).distinct().collect()}
    assert 5 <= len(now & before) < len(before)
    want = {*[(f"p{i}", 1, "a") for i in range(3, 40)], ("p0", 3, "y"), ("p1", 1, "again"), ("p2", 2, "new"), (None, 1, "n")}
    assert _all(spark, path) == want
    streams.merge_batch(second, path, 1, buckets=8)
    assert _all(spark, path) == want
    streams.merge_batch(frame([]), path, 2, buckets=8)
    assert _all(spark, path) == want


def _all(spark, path):
    return {tuple(r) for r in streams.merged_points(spark, path).select("point_id", "version", "text").collect()}


def test_half_replaced_table_is_completed(spark, tmp_path):
    path = str(tmp_path / "table")
    schema = "point_id string, version int, text string"
    streams.merge_batch(spark.createDataFrame([("a", 1, "old"), ("b", 1, "b")], schema), path, 0, buckets=1)
    update = spark.createDataFrame([("a", 2, "new")], schema)
    streams.merge_batch(update, path, 1, buckets=1)
    streams._remove(spark, f"{path}/bucket=0")  # the driver is lost after the old bucket went
    streams.merge_batch(update, path, 1, buckets=1)
    assert _all(spark, path) == {("a", 2, "new"), ("b", 1, "b")}


def test_flags_without_a_time_count_last(spark, tmp_path):
    """As ORDER BY does it; rows that are no flags do not reach the state of a case without timers."""
    flag, path = "flag_for_finetuning", str(tmp_path / "in")
    _flags(spark, path, [("a", 1, flag, None), ("a", 2, flag, 1), ("a", 9, "reject", 0), ("a", 3, flag, 2)])
    assert _run(spark, tmp_path, threshold=2) == [("a", "3")]
