"""Dense vectors: encoding, statistics, neighbours and search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.operators.topk import nearest
from rankloom.session import shared_folder

ENCODE_BATCH = 32


def encode(
    df: DataFrame,
    text: str,
    load_encoder: Callable[[], Callable[[list[str]], np.ndarray]],
    batch_size: int = ENCODE_BATCH,
    out: str = "vector",
) -> DataFrame:
    """Add a float vector per text with a caller's encoder, loaded once per task.

    ``load_encoder()`` returns a function from a list of texts to a 2-D array.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder()
        for batch in batches:
            for at in range(0, batch.num_rows, batch_size):
                part = batch.slice(at, batch_size)
                texts = [t or "" for t in part.column(text).to_pylist()]
                rows = np.asarray(encoder(texts), dtype=np.float32)
                offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
                vector = pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, vector], [*names, out])

    return df.mapInArrow(run, schema)


def vector_stats(vectors: DataFrame, vector: str = "vector") -> DataFrame:
    """Rows, dimension and size in MB (four bytes a value)."""
    size = F.size(vector)
    return vectors.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max(size).alias("dimension"),
        (F.sum(size.cast("long")) * 4 / F.lit(1048576.0)).alias("size_mb"),
    )


def run_config(
    vectors: DataFrame, model_name: str, input_file: str, embeddings_file: str, metadata_file: str
) -> DataFrame:
    """The one-row record describing an embedding run."""
    return vectors.agg(
        F.lit(model_name).alias("model_name"),
        F.max(F.size("vector")).alias("embedding_dimension"),
        F.count(F.lit(1)).alias("num_assessments"),
    ).select(
        "*",
        F.lit(input_file).alias("input_file"),
        F.lit(embeddings_file).alias("embeddings_file"),
        F.lit(metadata_file).alias("metadata_file"),
    )


def sample_items(items: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n distinct items (all, if fewer), the same ones for the same seed."""
    order = F.md5(F.concat(F.col("item_id").cast("string"), F.lit(f":{seed}")))
    return items.orderBy(order, "item_id").limit(n)


def neighbours(items: DataFrame, sampled: DataFrame, k: int = 5, payload=(), decimals: int | None = None) -> DataFrame:
    """The k most similar *other* items of each sampled item.

    One extra row is ranked and the item itself taken out by id, so an exact
    copy of the item stays among its neighbours.
    """
    queries = sampled.select(F.col("item_id").alias("query_id"), "vector")
    ranked = nearest(items, queries, k + 1, payload=payload, decimals=decimals)
    # Rows of a query are together already, so this window moves no data. The
    # item itself may be missing, if more than k copies of it come first.
    own = F.max(F.when(F.col("item_id") == F.col("query_id"), F.col("rank"))).over(Window.partitionBy("query_id"))
    after = ranked.withColumn("_own", own).where(F.col("item_id") != F.col("query_id"))
    passed = F.coalesce((F.col("rank") > F.col("_own")).cast("int"), F.lit(0))
    return after.withColumn("rank", F.col("rank") - passed).where(F.col("rank") <= k).drop("_own")


def recommend_dense(
    items: DataFrame, queries: DataFrame, k: int = 10, payload=("name", "url", "item_type"), decimals: int | None = None
) -> DataFrame:
    """Cosine top-k, the type filter applied before the cut.

    ``queries`` hold query_id, vector, query_type and may hold a smaller own k.
    """
    typed = items.where(F.col("item_type").isNotNull())
    ranked = nearest(typed, queries, k, payload=payload, decimals=decimals)
    if "k" not in queries.columns:
        return ranked
    return (
        ranked.join(queries.select("query_id", F.col("k").alias("_k")), "query_id")
        .where(F.col("rank") <= F.col("_k"))
        .drop("_k")
    )


def text_search(items: DataFrame, queries: DataFrame, load_encoder, k: int = 5, decimals: int | None = None) -> DataFrame:
    """Encode the query texts and find the k most similar items with their metadata.

    The queries' vectors are written once, so each text is encoded once.
    """
    shared_folder(queries.sparkSession)
    encoded = encode(queries.select("query_id", "query"), "query", load_encoder).select("query_id", "vector").checkpoint()
    return nearest(items, encoded, k, payload=["name", "item_type", "url"], decimals=decimals)


def l2_nearest(items: DataFrame, queries: DataFrame, k: int, payload=(), decimals: int | None = None) -> DataFrame:
    """Exact k nearest by squared Euclidean distance."""
    ranked = nearest(items, queries, k, metric="l2", payload=payload, decimals=decimals)
    return ranked.withColumn("distance", F.abs("score")).drop("score")
