"""Search history and analytics over append-only log tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators.rank import top_rows
from rankloom.schemas import ITEM_TYPES


def logged(searches: DataFrame) -> DataFrame:
    """Only searches that were computed are logged, not cached repeats."""
    return searches.where(~F.coalesce(F.col("cached"), F.lit(False)))


def history_rows(searches: DataFrame) -> DataFrame:
    return searches.select(
        "id", "session_id", "query", "result_count", "method", "query_time_ms", "item_type", "created_at"
    )


def analytics_rows(searches: DataFrame) -> DataFrame:
    return searches.select(
        "id", "query", "result_count", "method", "query_time_ms", F.lit(False).alias("cached"), "created_at"
    )


def latest(history: DataFrame, limit: int = 20) -> DataFrame:
    """Each session's latest searches, equal times by the higher id."""
    ranked = top_rows(history, ["session_id"], [F.col("created_at").desc(), F.col("id").desc()], limit)
    count = F.coalesce("result_count", F.lit(0)).alias("result_count")
    return ranked.select("session_id", "rank", "query", count, "method", "item_type", "created_at")


def session_history(history: DataFrame, session_id: str, limit: int = 20) -> DataFrame:
    """One session's latest searches."""
    return (
        history.where(F.col("session_id") == session_id)
        .orderBy(F.col("created_at").desc(), F.col("id").desc())
        .limit(limit)
        .select("query", "result_count", "method", "item_type", "created_at")
    )


def without_sessions(history: DataFrame, sessions: DataFrame) -> DataFrame:
    """The history with all searches of the named sessions deleted."""
    return history.join(sessions.select("session_id").distinct(), "session_id", "left_anti")


def query_summary(analytics: DataFrame) -> DataFrame:
    return analytics.agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.bround(F.coalesce(F.avg("query_time_ms"), F.lit(0.0)), 2).alias("avg_query_time_ms"),
    )


def top_queries(analytics: DataFrame, limit: int = 10) -> DataFrame:
    """Most frequent queries, case ignored, shown in their smallest spelling.

    Counting by spelling first keeps the wide aggregation a hash aggregation;
    the spelling is then chosen among few rows.
    """
    spelled = analytics.groupBy(F.lower("query").alias("_key"), "query").agg(F.count(F.lit(1)).alias("n"))
    merged = spelled.groupBy("_key").agg(F.min("query").alias("query"), F.sum("n").alias("count"))
    return merged.orderBy(F.col("count").desc(), F.col("_key")).limit(limit).select("query", "count")


def stats_row(analytics: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog size, supported types, query totals and top queries in one row."""
    top = top_queries(analytics).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("o"), "query", "count"))),
            lambda s: F.struct(s["query"].alias("query"), s["count"].alias("count")),
        ).alias("top_queries")
    )
    size = catalog.agg(F.count(F.lit(1)).alias("n"))
    return query_summary(analytics).select(
        size.scalar().alias("total_items"),
        F.array(*[F.lit(t) for t in ITEM_TYPES]).alias("supported_types"),
        "total_queries",
        "avg_query_time_ms",
        top.scalar().alias("top_queries"),
    )


def cache_usage(requests: DataFrame) -> DataFrame:
    """Share of requests answered from the cache, and the average time."""
    return requests.agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.avg(F.col("cached").cast("int")).alias("cache_hit_rate"),
        F.bround(F.coalesce(F.avg("query_time_ms"), F.lit(0.0)), 2).alias("avg_query_time_ms"),
    )


def top_items(results: DataFrame, limit: int = 10) -> DataFrame:
    """Items recommended most often."""
    counts = results.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), "item_id").limit(limit)


def result_types(results: DataFrame) -> DataFrame:
    """How often each type was recommended."""
    return results.groupBy("item_type").agg(F.count(F.lit(1)).alias("n"))
