"""Result files: CSV lines and JSON envelopes.

A query's results are its top k, so one envelope holds at most k rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.schemas import ITEM_TYPE, NAME, URL


def _result_columns() -> list[Column]:
    return [
        F.col("name").alias(NAME), F.col("url").alias(URL), F.col("score"), F.col("item_type").alias(ITEM_TYPE),
    ]


def csv_rows(results: DataFrame) -> DataFrame:
    """The four exported columns; any other column is left behind."""
    return results.select(*_result_columns())


def write_csv(results: DataFrame, path: str, quote_all: bool = False) -> None:
    """Headered CSV files, every value quoted if asked for."""
    writer = csv_rows(results).write.mode("overwrite").option("header", True)
    writer.option("escape", '"').option("quoteAll", quote_all).csv(path)


def csv_lines(results: DataFrame, quote_all: bool = False) -> DataFrame:
    """The exported rows as text lines, with query_id and rank to order them."""
    options = {"escape": '"', "quoteAll": str(quote_all).lower()}
    return results.select("query_id", "rank", F.to_csv(F.struct(*_result_columns()), options).alias("line"))


def exported_at(at: Column | None = None) -> Column:
    return F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd HH:mm:ss")


def _result_list() -> Column:
    ordered = F.sort_array(F.collect_list(F.struct(F.col("rank"), F.struct(*_result_columns()).alias("r"))))
    return F.transform(ordered, lambda s: s["r"])


def json_envelopes(results: DataFrame, at: Column | None = None) -> DataFrame:
    """(query_id, json): query, export time, total and the results of each query."""
    grouped = results.groupBy("query_id", "query").agg(
        F.count(F.lit(1)).alias("total"), _result_list().alias("results")
    )
    body = F.struct("query", exported_at(at).alias("exported_at"), "total", "results")
    return grouped.select("query_id", F.to_json(body).alias("json"))


def json_plain(results: DataFrame) -> DataFrame:
    """(query_id, json): the short envelope of query and results."""
    grouped = results.groupBy("query_id", "query").agg(_result_list().alias("results"))
    return grouped.select("query_id", F.to_json(F.struct("query", "results")).alias("json"))


def write_json(envelopes: DataFrame, path: str) -> None:
    """One envelope per line."""
    envelopes.select(F.col("json").alias("value")).write.mode("overwrite").text(path)
