"""Vectors stored by the digest of their text: every text is encoded once for ever.

Texts that the store doesn't hold are encoded and added block by block, a block being
a range of digests. A block is added whole, so a run that fails keeps the blocks
before, and the next run encodes only the others.

Defined results: a null text is encoded as an empty one. Equal texts have one vector.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.vectors import ENCODE_BATCH, encode
from rankloom.session import materialise

BLOCKS = 4
_SCHEMA = "digest string, vector array<float>, block int"


def stored(spark: SparkSession, path: str) -> DataFrame:
    """(digest, vector, block) of all stored texts."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], _SCHEMA)
    return spark.read.schema(_SCHEMA).parquet(path)


def _digest(text: str):
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def add_missing(
    df: DataFrame,
    text: str,
    load_encoder: Callable[[], Callable[[list[str]], np.ndarray]],
    path: str,
    batch_size: int = ENCODE_BATCH,
    blocks: int = BLOCKS,
) -> int:
    """Encode the texts that the store at ``path`` doesn't hold, in up to 256 ``blocks``; returns how many there were.

    Only these are shuffled, copies combined before. Texts of like length share a batch of the encoder.
    """
    spark = df.sparkSession
    digested = df.select(_digest(text).alias("digest"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    new = digested.join(stored(spark, path).select("digest"), "digest", "left_anti").groupBy("digest").agg(F.first("text").alias("text"))
    place = F.conv(F.substring("digest", 1, 2), 16, 10).cast("int")
    new = materialise(new.withColumn("block", F.floor(place * blocks / 256).cast("int")))
    sizes = {r.block: r["count"] for r in new.groupBy("block").count().collect()}  # a row a block
    for block in sorted(sizes):
        part = new.where(F.col("block") == block).repartition(spark.sparkContext.defaultParallelism, "digest")
        made = encode(part.sortWithinPartitions(F.length("text")).select("digest", "text"), "text", load_encoder, batch_size)
        made.select("digest", "vector").write.mode("append").parquet(f"{path}/block={block}")
    return sum(sizes.values())


def encode_stored(
    df: DataFrame, text: str, load_encoder: Callable[[], Callable[[list[str]], np.ndarray]], path: str, batch_size: int = ENCODE_BATCH, out: str = "vector"
) -> DataFrame:
    """``df`` with a vector per text from the store at ``path``, which gets those it lacks."""
    add_missing(df, text, load_encoder, path, batch_size)
    vectors = stored(df.sparkSession, path).select(F.col("digest").alias("_digest"), F.col("vector").alias(out))
    return df.withColumn("_digest", _digest(text)).join(vectors, "_digest", "left").drop("_digest")
