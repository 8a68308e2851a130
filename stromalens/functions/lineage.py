"""Cutting lineage for jobs that iterate or branch."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_RELEASED_AT_EXIT: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, inside the cluster's checkpoint folder.

    Where the session names none, a session on one machine (tests, a laptop) gets a folder of
    its own; on a cluster that would be a folder that the other machines do not see. The
    folder goes with the driver, or earlier by ``release``.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    if base is None:
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    app = spark.sparkContext.applicationId
    if app not in _RELEASED_AT_EXIT:
        _RELEASED_AT_EXIT.add(app)
        atexit.register(_at_exit, spark)
    return f"{base.rstrip('/')}/run-{app}"


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; results that read them must be written before."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _at_exit(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        release(spark)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    A written table survives the loss of executors, is computed once for every
    branch that reads it, and gives the optimizer real sizes to decide broadcasts on.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """Use all cores for costly row work on a table stored in a few files.

    A table with at least as many splits as cores is left alone, so big inputs are
    not shuffled for this.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
