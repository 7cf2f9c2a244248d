"""Answering a batch of requests: lexical pool, re-ranking, type filter, fallback."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import session_or_new
from rankloom.operators import rank as rk
from rankloom.operators import rerank as rr
from rankloom.operators.tfidf import POOL, TfidfIndex, retrieve
from rankloom.operators.vectors import recommend_dense
from rankloom.session import materialise

DEFAULT_K = 10


def prepare_requests(requests: DataFrame) -> DataFrame:
    """Default k, and a session for requests without one."""
    return requests.withColumns(
        {"k": F.coalesce("k", F.lit(DEFAULT_K)), "session_id": session_or_new(F.col("session_id"))}
    )


def pools_for(index: TfidfIndex, items: DataFrame, queries: DataFrame, decimals: int | None = None) -> DataFrame:
    """(query_id, query, k, query_type, pool) with each query's lexical candidates.

    The re-ranker is asked for twice the wanted number, as the type filter
    comes after it.
    """
    ranked = retrieve(index, items, queries, POOL, payload=["name", "url", "item_type"], decimals=decimals)
    return queries.join(rr.pack_pool(ranked), "query_id")


def recommend_lexical(pools: DataFrame, responses: DataFrame | None) -> DataFrame:
    """Re-rank to 2k, filter the type, keep k: one row per query with ``chosen``."""
    doubled = pools.withColumn("k", F.col("k") * 2)
    chosen = rr.rerank(doubled, responses).withColumn("k", (F.col("k") / 2).cast("int"))
    return chosen.withColumn("chosen", rr.cut_by_type(F.col("chosen"), F.col("query_type"), F.col("k")))


def answer(
    requests: DataFrame,
    index: TfidfIndex,
    items: DataFrame,
    responses: DataFrame | None = None,
    load_answerer: Callable | None = None,
    dense: tuple[DataFrame, DataFrame] | None = None,
    batch_size: int | None = None,
    decimals: int | None = None,
) -> DataFrame:
    """One row per request: query_id, cached, reranked, method and the array ``chosen``.

    ``requests``: request_id, query, k, item_type, and optionally ``failed``
    to have a request answered by dense search. Equal requests are computed
    once; repeats are marked cached. ``responses`` (query_id, content) or
    ``load_answerer`` gives the re-ranker's answers; the query_id of a request
    is the first request_id equal to it. ``dense`` = (items with vectors,
    queries with query_id and vector) serves the failed ones; one without a
    vector has no result, and without ``dense`` nothing counts as failed. Answers
    are asked for once and written, so results and logs agree.
    """
    distinct = materialise(rk.distinct_requests(requests))
    queries = distinct.select("query_id", "query", "k", F.col("item_type").alias("query_type"))
    # Written, as prompts, results and log rows are all made of them; 20 candidates a query.
    pools = materialise(pools_for(index, items, queries, decimals))
    if responses is None and load_answerer is not None:
        asked = rr.build_prompts(pools.withColumn("k", F.col("k") * 2))
        responses = materialise(rr.answer_prompts(asked, load_answerer, batch_size))
    primary = recommend_lexical(pools, responses).select("query_id", "reranked", "chosen")
    missing = F.lit("rag")
    if dense is not None and "failed" in requests.columns:
        failed = requests.where("failed").select(F.col("request_id").alias("query_id"))
        vectors = dense[1].join(failed, "query_id", "left_semi").join(queries, "query_id")
        missing = F.when(F.col("failed"), F.lit("semantic")).otherwise(missing)
        primary = rk.with_fallback(primary, _spare(dense[0], vectors, decimals), failed)
    else:
        primary = primary.withColumn("method", F.lit("rag"))
    # Written, as results and log rows are made of it: one row per distinct request
    # with its list. It joins each of its repeats; lists open after.
    primary = materialise(primary)
    tagged = rk.attach_representative(requests, distinct)
    return tagged.join(primary, "query_id", "left").withColumn(
        "method", F.when(F.col("cached"), F.lit("cached")).otherwise(F.coalesce("method", missing))
    )


def _spare(items: DataFrame, vectors: DataFrame, decimals: int | None) -> DataFrame:
    """Dense results (query_id, reranked, chosen) of the failed requests, each to its own k.

    Requests are ranked in groups of like k, so that one that asks for many
    results doesn't deepen the ranking of all; only the few group sizes reach
    the driver.
    """
    size = F.pow(F.lit(2), F.ceil(F.log2(F.greatest("k", F.lit(1))))).cast("int")
    sized = materialise(vectors.withColumn("_size", size))
    found, sizes = None, sized.select("_size").distinct().orderBy("_size").collect()
    if len(sizes) > 1:
        # Written once, as every group reads all items.
        items = materialise(items.select("item_id", "vector", "name", "url", "item_type"))
    for row in sizes:
        part = recommend_dense(items, sized.where(F.col("_size") == row[0]).drop("_size"), row[0], decimals=decimals)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = recommend_dense(items, vectors, 1, decimals=decimals)
    return rr.pack_pool(found).select("query_id", F.lit(False).alias("reranked"), F.col("pool").alias("chosen"))


def results(answers: DataFrame) -> DataFrame:
    """One row per result: request_id, rank, item, score, method, cached, reranked."""
    columns = ["request_id", "query_id", "query", "cached", "reranked", "method", "chosen"]
    return rk.result_defaults(rr.unpack(answers.select(*columns)))


def searches(answers: DataFrame, times: DataFrame) -> DataFrame:
    """Rows for the search log, one per request, also one with no result left.

    ``times`` holds request_id, query_time_ms and created_at.
    """
    return answers.join(times, "request_id", "left").select(
        F.col("request_id").alias("id"),
        "session_id",
        "query",
        F.greatest(F.size("chosen"), F.lit(0)).alias("result_count"),
        "method",
        F.bround("query_time_ms", 2).alias("query_time_ms"),
        "item_type",
        "created_at",
        "cached",
    )
