import random

import pytest
from pyspark.sql import functions as F

from rankloom.operators import result_cache

SCHEMA = "request_id long, query string, k int, item_type string, extra string"


def plainly(batches, capacity):
    """Status of every request, and the keys left in the store, one request after the other."""
    store, out = [], {}
    for rows in batches:
        first, had = {}, set(store)
        for request, *key, _ in rows:
            first.setdefault(tuple(key), request)
        for request, *key, _ in rows:
            key = tuple(key)
            out[request] = "stored" if key in had else "computed" if first[key] == request else "repeat"
        store = [*store, *(k for k in first if k not in had)][-capacity:]
    return out, store


@pytest.mark.parametrize("capacity", [3, 40, 1000])
def test_batches_as_one_request_after_the_other(spark, tmp_path, capacity):
    rng = random.Random(capacity)
    batches, at = [], 0
    for size in (60, 90, 90):
        batches.append([(at + k, rng.choice(["a", "b", "A", None]), rng.randint(1, 4), rng.choice([None, "", "t"]), "x") for k in range(size)])
        at += size
    calls = []

    def compute(new):
        calls.append(new.count())
        return new.where("k < 4").select("query_id", F.concat(F.coalesce("query", F.lit("-")), "k").alias("answer"))

    store, found = None, {}
    for number, rows in enumerate(batches):
        answers, store = result_cache.serve(spark.createDataFrame(rows, SCHEMA), store, compute, number, capacity)
        assert answers.columns == ["request_id", "query", "k", "item_type", "extra", "query_id", "status", "answer"]
        for r in answers.collect():
            assert r.request_id not in found and r.answer == (None if r.k == 4 else f"{r.query or '-'}{r.k}")
            found[r.request_id] = r.status
        result_cache.save(store, str(tmp_path / f"s{number}"))
        store = result_cache.load(spark, str(tmp_path / f"s{number}"))
    want, keys = plainly(batches, capacity)
    assert found == want
    assert sorted(repr((r["query"], r.k, r.item_type)) for r in store.collect()) == sorted(map(repr, keys))
    assert sum(calls) == sum(s == "computed" for s in want.values())


def test_filter_lets_all_stored_keys_pass_and_few_others(spark):
    keys = spark.range(1000).select(F.col("id").cast("string").alias("query"), F.lit(1).alias("k"), F.lit(None).cast("string").alias("item_type"))
    may_hold = result_cache.bloom_filter(keys, result_cache.KEY, 1000)
    others = keys.withColumn("query", F.concat("query", F.lit("x")))
    assert keys.where(may_hold()).count() == 1000 and others.where(may_hold()).count() < 60
    none = result_cache.bloom_filter(keys.where("false"), result_cache.KEY, 1000)
    assert keys.where(none()).count() == 0


def test_empty_batches_and_counts(spark):
    rows = [(1, "a", 1, None, "x"), (2, "a", 1, None, "x"), (3, "b", 1, None, "x")]
    frame, compute = spark.createDataFrame(rows, SCHEMA), lambda new: new.select("query_id", F.lit(1).alias("n"))
    none, empty = result_cache.serve(frame.where("false"), None, compute, 0)
    assert none.count() == 0 == empty.count()
    answers, store = result_cache.serve(frame, empty, compute, 1, 1)
    assert tuple(result_cache.counts(answers, empty, store, 1).first()) == (1, 3, 0, 1, 2, 1)
    again, last = result_cache.serve(frame.where("false"), store, compute, 2, 1)
    assert again.count() == 0 and last.collect() == store.collect()
