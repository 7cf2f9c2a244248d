"""Results kept between batches of requests, first in, first out.

The store is a table of one row per request key with its results. A batch takes
what the store has, computes each other key once and puts it into the store,
which then keeps the last ``capacity`` keys in the order of their coming: by
batch, then by the first request of a key. A hit does not move a key.

Most keys of a batch are new, so a Bloom filter over the stored keys, of at most
``WORDS`` numbers, lets only those pass to the join that may be there. A key asked
for by a great part of all requests is among the ``HOT`` most frequent, which meet
their requests by broadcast; the others join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.rank import distinct_requests
from rankloom.session import materialise

CAPACITY = 1000
KEY = ("query", "k", "item_type")
WORDS, HASHES, HOT = 4096, 4, 64


def _places(key: Sequence[str], words: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(n), *key), F.lit(64 * words)) for n in range(HASHES)]


def bloom_filter(keys: DataFrame, key: Sequence[str], expected: int) -> Callable[[], Column]:
    """A test of whether a key may be among ``keys``; never wrong if it says no."""
    words = max(1, min(WORDS, -(-expected * 16 // 64)))
    place = keys.select(F.explode(F.array(*_places(key, words))).alias("place"))
    bit = F.expr("shiftleft(1L, int(place % 64))")
    rows = place.groupBy(F.expr("int(place div 64)").alias("word")).agg(F.bit_or(bit).alias("bits")).collect()  # at most WORDS rows
    bits = [0] * words
    for row in rows:
        bits[row["word"]] = row["bits"]

    def may_hold() -> Column:
        table = F.array(*(F.lit(b).cast("long") for b in bits))
        tests = [F.getbit(F.element_at(table, (F.floor(p / 64) + 1).cast("int")), p % 64) == 1 for p in _places(key, words)]
        out = tests[0]
        for test in tests[1:]:
            out = out & test
        return out

    return may_hold


def _same(key: Sequence[str], left: str = "", right: str = "_") -> Column:
    out = F.lit(True)
    for c in key:
        out = out & F.col(f"{left}{c}").eqNullSafe(F.col(f"{right}{c}"))
    return out


def serve(
    requests: DataFrame,
    store: DataFrame | None,
    compute: Callable[[DataFrame], DataFrame],
    batch: int,
    capacity: int = CAPACITY,
    key: Sequence[str] = KEY,
) -> tuple[DataFrame, DataFrame]:
    """(answers, new store) for one batch of requests (request_id and the key's columns, others are passed on).

    ``compute`` gives (query_id, result columns) for keys (key, query_id, n_requests)
    that the store lacks; a key that it gives no row has null results. ``store``
    is what the last batch returned, None at first; ``batch`` is a number that
    grows. Answers are the requests with ``query_id``, ``status`` (``stored`` if
    an earlier batch had the key, else ``computed`` for its first request and
    ``repeat`` for others) and the results. Both are written.
    """
    if capacity < 1:
        raise ValueError("a store holds one key at least")
    key = list(key)
    distinct = materialise(distinct_requests(requests, key))
    if store is None:
        hits, misses = None, distinct
    else:
        may_hold = bloom_filter(store, key, capacity)
        passed = distinct.withColumn("_may", may_hold())
        results = [c for c in store.columns if c not in (*key, "batch", "query_id")]
        kept = store.select(*(F.col(c).alias(f"_{c}") for c in key), *results)
        hits = materialise(passed.where("_may").drop("_may").join(kept, _same(key)).drop(*(f"_{c}" for c in key)))
        misses = distinct.join(hits.select("query_id"), "query_id", "left_anti")
    computed = compute(misses)
    made = materialise(misses.join(computed, "query_id", "left").withColumn("status", F.lit("computed")))
    results = [c for c in computed.columns if c != "query_id"]
    rows = made.select(*key, F.lit(batch).cast("long").alias("batch"), "query_id", *results)
    known = made
    if hits is not None:
        rows = rows.unionByName(store)
        known = made.unionByName(hits.withColumn("status", F.lit("stored")))
    kept = materialise(rows.orderBy(F.col("batch").desc(), F.col("query_id").desc()).limit(capacity))
    known = known.select(*(F.col(c).alias(f"_{c}") for c in key), "query_id", "n_requests", "status", *results)
    hot = materialise(known.orderBy(F.col("n_requests").desc(), "query_id").limit(HOT))
    few = F.broadcast(hot)
    others = known.join(F.broadcast(hot.select("query_id")), "query_id", "left_anti")
    asked = [c for c in requests.columns if c not in ("query_id", "status", *(c for c in results if c not in key))]
    frequent = requests.select(*asked).join(few, _same(key))
    rest = requests.select(*asked).join(few.select(*(f"_{c}" for c in key)), _same(key), "left_anti").join(others, _same(key))
    answers = frequent.unionByName(rest)
    repeat = (F.col("status") == "computed") & (F.col("request_id") != F.col("query_id"))
    status = F.when(repeat, F.lit("repeat")).otherwise(F.col("status"))
    return materialise(answers.select(*asked, "query_id", status.alias("status"), *results)), kept


def counts(answers: DataFrame, before: DataFrame | None, after: DataFrame, batch: int) -> DataFrame:
    """One row on a batch: requests, of them stored, repeat and computed, and the keys that left the store."""
    by = [F.count_if(F.col("status") == s).alias(s) for s in ("stored", "repeat", "computed")]
    old = 0 if before is None else before.count()
    row = answers.agg(F.count("*").alias("requests"), *by)
    return row.select(F.lit(batch).cast("long").alias("batch"), "*", (F.lit(old) + F.col("computed") - F.lit(after.count())).alias("evicted"))


def save(store: DataFrame, path: str) -> None:
    store.coalesce(1).write.parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
