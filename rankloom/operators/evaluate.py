"""Hit@K and Recall@K of ranked predictions against a truth set.

Truth entries are counted per (query, slug) rather than listed, so a query
with very many of them is combined map-side and never held in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import slug


def truth_counts(truth: DataFrame) -> DataFrame:
    """(query, slug, n): how often each slug is named for a query.

    Entries without a query or url are dropped; repeats count.
    """
    named = truth.where(F.col("query").isNotNull() & F.col("url").isNotNull())
    return named.groupBy("query", slug(F.col("url")).alias("slug")).agg(F.count(F.lit(1)).alias("n"))


def predicted_ranks(predictions: DataFrame, depth: int = 10) -> DataFrame:
    """(query, slug, rank): the best rank of each predicted slug."""
    return (
        predictions.where(F.col("rank") <= depth)
        .groupBy("query", slug(F.col("url")).alias("slug"))
        .agg(F.min("rank").alias("rank"))
    )


def query_metrics(truth: DataFrame, predictions: DataFrame, ks=(5, 10)) -> DataFrame:
    """Per query hit and recall at each k: hit if any truth entry is found,
    recall the found share of the entries."""
    counted = truth_counts(truth).join(predicted_ranks(predictions, max(ks)), ["query", "slug"], "left")
    columns = []
    for k in ks:
        found = F.when(F.col("rank") <= k, F.col("n")).otherwise(0)
        columns.append((F.sum(found) > 0).cast("int").alias(f"hit_{k}"))
        columns.append((F.sum(found) / F.sum("n")).alias(f"recall_{k}"))
    return counted.groupBy("query").agg(*columns)


def mean_metrics(per_query: DataFrame, ks=(5, 10)) -> DataFrame:
    names = [f"{m}_{k}" for k in ks for m in ("hit", "recall")]
    return per_query.agg(F.count(F.lit(1)).alias("n_queries"), *[F.avg(n).alias(n) for n in names])
