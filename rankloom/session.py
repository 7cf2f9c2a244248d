"""Session settings the jobs are written for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Set only where the launcher has not: a cluster's own values win.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("rankloom")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a private one only on a single machine."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not folder and not context.master.startswith("local"):
        raise RuntimeError("a cluster must name a shared folder in spark.checkpoint.dir")
    context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="rankloom-checkpoint-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, kind: str = "table") -> str:
    """The name of a new folder in the shared one, deleted by :func:`drop_materialised`."""
    path = f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialise(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Write a table that several jobs read into the shared folder and read it back.

    The rows survive lost executors, and later jobs read only their columns.
    ``tasks`` deals them to so many files first, for sources of few large row
    groups, which few tasks could read.
    :func:`drop_materialised` deletes what a session has written so.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    (df.repartition(tasks) if tasks else df).write.parquet(path)
    return spark.read.parquet(path)


_made: dict[str, list[str]] = {}


def drop_materialised(spark: SparkSession) -> int:
    """Delete the tables this application has materialised; results read from them must be written by then."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)
