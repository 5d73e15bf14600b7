"""Session helpers: local session for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "spindle") -> SparkSession:
    """A local session configured the way the operators expect (UTC, AQE on, UI off)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPINDLE_DRIVER_MEMORY", "16g"))
    )
    log_dir = os.environ.get("SPINDLE_EVENT_LOG")  # profiling: stage/task times without the UI
    if log_dir:
        spark = (spark.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", log_dir)
                 .config("spark.eventLog.compress", "false").config("spark.eventLog.rolling.enabled", "false"))
    spark = spark.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Where the session has none, a local session (one machine) gets a new folder under the system's
    temp directory; on a cluster that folder would be the driver's own disk, so it is an error.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not is_local(sc.master):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="spindle-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def is_local(master: str) -> bool:
    """Whether driver and executors are one process (``local-cluster`` is not)."""
    return master == "local" or master.startswith("local[")


_made: list[str] = []  # scratch paths handed out by this process


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    _made.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}")
    return _made[-1]


def remove_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables this process has made (call when their results have been used). Returns their number."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def materialize(df: DataFrame, name: str = "stage", sort: Sequence[str] = ()) -> DataFrame:
    """Cut lineage by writing Parquet to the shared folder and reading it back. ``sort`` orders each file, so that
    filters on those columns skip its row groups and pages.

    Unlike ``cache`` this survives executor loss, and unlike executor-local
    checkpoints it does not depend on blocks held by one executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    (df.sortWithinPartitions(*sort) if sort else df).write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
