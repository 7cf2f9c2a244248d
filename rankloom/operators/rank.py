"""Top rows per group, result shaping and the filters around them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.text import DEFAULT_TYPE, no_type_filter

_SALT = "_salt"


def wide_salts(df: DataFrame) -> int:
    """Sub-groups for :func:`top_rows`: more the wider the session shuffles, one on a small one."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(64, width // 8))


def top_rows(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank: str = "rank",
    salts: int = 1,
) -> DataFrame:
    """First ``k`` rows of every group under a total order, with their rank.

    Each map task keeps at most ``k`` rows of a group before the shuffle
    (WindowGroupLimit), so a hot group arrives as k rows per map task and not
    whole. Where *every* group is met by every task, ``salts`` > 1 first
    narrows salted sub-groups, so the last task of a group sees salts * k rows;
    for mostly small groups that second shuffle would cost more than it saves.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if salts > 1:
        salted = df.withColumn(_SALT, F.spark_partition_id() % salts)
        narrow = Window.partitionBy(*by, _SALT).orderBy(*order)
        df = salted.withColumn(rank, F.row_number().over(narrow)).where(F.col(rank) <= k).drop(_SALT, rank)
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def keep_first(df: DataFrame, key: str | Sequence[str], order: str) -> DataFrame:
    """One row per key, the first in ``order``; null keys count as equal."""
    keys = [key] if isinstance(key, str) else list(key)
    return top_rows(df, keys, [F.col(order).asc()], 1, rank="_first").drop("_first")


def filter_type(results: DataFrame, wanted: Column, item_type: str = "item_type") -> DataFrame:
    """Rows of the wanted type, case ignored; null, empty or ``all`` keeps every row."""
    return results.where(no_type_filter(wanted) | (F.lower(F.col(item_type)) == F.lower(wanted)))


def overfetch(ranked: DataFrame, requests: DataFrame, pool: int = 20) -> DataFrame:
    """Filter *after* the cut: of each request's first 2k pool rows keep its type, then k.

    ``ranked`` holds (query_id, rank, ...); ``requests`` (query_id, k, query_type).
    """
    cut = (
        ranked.where(F.col("rank") <= pool)
        .join(requests.select("query_id", "k", "query_type"), "query_id")
        .where(F.col("rank") <= 2 * F.col("k"))
    )
    cut = filter_type(cut, F.col("query_type"))
    window = Window.partitionBy("query_id").orderBy("rank")
    return (
        cut.withColumn("new_rank", F.row_number().over(window))
        .where(F.col("new_rank") <= F.col("k"))
        .withColumn("rank", F.col("new_rank"))
        .drop("new_rank", "k", "query_type")
    )


def with_fallback(primary: DataFrame, fallback: DataFrame, failed: DataFrame) -> DataFrame:
    """Primary rows, and fallback rows for the queries named in ``failed``.

    An empty primary result is not a failure; only ``failed`` (query_id) decides.
    """
    kept = primary.join(failed.select("query_id"), "query_id", "left_anti").withColumn("method", F.lit("rag"))
    spare = fallback.join(failed.select("query_id"), "query_id", "left_semi").withColumn("method", F.lit("semantic"))
    return kept.unionByName(spare)


def tag_first(results: DataFrame, method: str = "method") -> DataFrame:
    """The method is shown on the first result only."""
    return results.withColumn(method, F.when(F.col("rank") == 1, F.col(method)))


def distinct_requests(requests: DataFrame, key: Sequence[str] = ("query", "k", "item_type")) -> DataFrame:
    """Each distinct request once, known by its first ``request_id``.

    Counting and the first id are combined map-side, so a request repeated by
    a third of all rows shuffles one row per task.
    """
    return requests.groupBy(*key).agg(
        F.min("request_id").alias("query_id"), F.count(F.lit(1)).alias("n_requests")
    )


def attach_representative(
    requests: DataFrame, distinct: DataFrame, key: Sequence[str] = ("query", "k", "item_type")
) -> DataFrame:
    """Every request with the ``query_id`` that answers it; repeats are ``cached``.

    One row joins one row. The distinct side is small or AQE splits the hot
    key's partition, as nothing above asks for the join's partitioning.
    """
    right = distinct.select(*[F.col(c).alias(f"_{c}") for c in key], "query_id")
    match = F.lit(True)
    for c in key:
        match = match & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return (
        requests.join(right, match)
        .drop(*[f"_{c}" for c in key])
        .withColumn("cached", F.col("request_id") != F.col("query_id"))
    )


def result_defaults(results: DataFrame) -> DataFrame:
    """Fill what a result may lack: name, url, numeric score, type."""
    return results.select(
        *[c for c in results.columns if c not in ("name", "url", "score", "item_type")],
        F.coalesce("name", F.lit("Unknown")).alias("name"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce(F.col("score").try_cast("double"), F.lit(0.0)).alias("score"),
        F.coalesce("item_type", F.lit(DEFAULT_TYPE)).alias("item_type"),
    )


def shown_of_total(results: DataFrame, wanted: str) -> DataFrame:
    """How many results of each query an exact type choice shows, of how many."""
    shown = F.lit(True) if wanted == "all" else F.col("item_type") == wanted
    return results.groupBy("query_id").agg(
        F.count_if(shown).alias("shown"), F.count(F.lit(1)).alias("total")
    )


def preview(df: DataFrame, order: str, n: int, cuts: dict[str, int]) -> DataFrame:
    """The first ``n`` rows with some texts cut short."""
    columns = [
        F.substring(F.col(c), 1, cuts[c]).alias(c) if c in cuts else F.col(c) for c in df.columns
    ]
    return df.orderBy(order).limit(n).select(*columns)
