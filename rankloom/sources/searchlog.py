"""The two search log tables as partitioned parquet."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom import schemas
from rankloom.operators.searchlog import analytics_rows, history_rows, logged, without_sessions
from rankloom.session import materialise
from rankloom.sources.daylog import DayLog

BUCKETS = 64


def _bucket(session_id, buckets):
    return F.pmod(F.xxhash64(session_id), F.lit(buckets)).cast("int")


def append_searches(
    searches: DataFrame, history_path: str, analytics_path: str, batch: str, buckets: int = BUCKETS, files_per_bucket: int = 4
) -> None:
    """Write one batch of searches to both logs under its own ``batch`` folder.

    Writing a batch again replaces its folder, so a retried batch counts once.
    History is laid out by session bucket, so a session is read from one folder
    per batch, and the rows of a bucket are spread over a few files, a busy
    session's too.
    """
    # Both logs come from one computation of the batch. Blocks are recomputed if lost.
    computed = logged(searches).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        history = history_rows(computed).withColumn("bucket", _bucket("session_id", buckets))
        # A bucket's rows meet in a few tasks, so a batch makes few files a bucket.
        dealt = history.repartition(buckets, "bucket", F.pmod(F.xxhash64("id"), F.lit(files_per_bucket)))
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{history_path}/batch={batch}")
        analytics_rows(computed).write.mode("overwrite").parquet(f"{analytics_path}/batch={batch}")
    finally:
        computed.unpersist()


def _stored(schema: T.StructType, *folders: T.StructField) -> T.StructType:
    return T.StructType([*schema.fields, *folders])


_BATCH = T.StructField("batch", T.StringType())
_BUCKET = T.StructField("bucket", T.IntegerType())


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_stored(schemas.SEARCH_HISTORY, _BATCH, _BUCKET)).parquet(path)


def read_analytics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_stored(schemas.QUERY_ANALYTICS, _BATCH)).parquet(path)


def clear_sessions(spark: SparkSession, path: str, sessions: DataFrame, buckets: int = BUCKETS) -> int:
    """Delete these sessions from the history at ``path``; returns how many buckets were rewritten.

    Only folders of the sessions' buckets are rewritten; all other files stay as
    they are. Their remaining rows are written to the shared folder first, then
    replace their folders, so a failure on the way can be repeated.
    """
    touched = [r[0] for r in sessions.select(_bucket("session_id", buckets).alias("b")).distinct().collect()]
    if not touched:
        return 0
    history = read_history(spark, path).where(F.col("bucket").isin(touched))
    kept = materialise(without_sessions(history, sessions))
    # Partitions that lose all rows have no row to overwrite them by, so they are dropped by name.
    before = {tuple(r) for r in history.select("batch", "bucket").distinct().collect()}
    after = {tuple(r) for r in kept.select("batch", "bucket").distinct().collect()}
    writer = kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("batch", "bucket").parquet(path)
    for batch, bucket in before - after:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={batch}/bucket={bucket}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return len(touched)


def one_session(history: DataFrame, session_id: str, buckets: int = BUCKETS) -> DataFrame:
    """Read a session from its bucket's folders only."""
    wanted = history.sparkSession.range(1).select(_bucket(F.lit(session_id), buckets)).first()[0]
    return history.where((F.col("bucket") == wanted) & (F.col("session_id") == session_id))


def day_logs(spark: SparkSession, path: str, buckets: int = BUCKETS) -> tuple[DayLog, DayLog]:
    """History and analytics below ``path`` as logs of numbered batches, with late deletes and compaction.

    A compacted day of the history has a folder a bucket, so choose few for small logs.
    Analytics are read by day and never by id, so they have one.
    """
    history = DayLog(spark, f"{path}/history", schemas.SEARCH_HISTORY, "session_id", buckets=buckets)
    return history, DayLog(spark, f"{path}/analytics", schemas.QUERY_ANALYTICS, "id", buckets=1)


def append_numbered(searches: DataFrame, logs: tuple[DayLog, DayLog], number: int) -> None:
    """Write one batch of searches to both logs. A batch that failed between them is written again under its number."""
    computed = logged(searches).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for log, rows in zip(logs, (history_rows(computed), analytics_rows(computed)), strict=True):
            log.append(rows, number)
    finally:
        computed.unpersist()
