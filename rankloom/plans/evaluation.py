"""Hit@K and Recall@K of dense recommendation over a truth set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators.evaluate import mean_metrics, query_metrics
from rankloom.operators.vectors import recommend_dense


def evaluate_dense(truth: DataFrame, queries: DataFrame, items: DataFrame, ks=(5, 10), decimals: int | None = None) -> DataFrame:
    """One row of mean metrics; all truth queries are answered as one batch.

    ``truth``: query, url; ``queries``: query_id, query, vector, one per
    distinct truth query.
    """
    ranked = recommend_dense(items, queries.select("query_id", "vector"), max(ks), decimals=decimals)
    named = ranked.join(queries.select("query_id", F.col("query")), "query_id")
    return mean_metrics(query_metrics(truth, named, ks), ks)
