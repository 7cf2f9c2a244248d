import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import postings
from rankloom.operators.topk import nearest

SCHEMA = "item_id long, indices array<int>, weights array<double>, name string"


def make(n, terms, seed, coarse):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        own = np.sort(rng.choice(terms, rng.integers(0, 9), replace=False, p=(p := 1 / np.arange(1, terms + 1)) / p.sum()))
        weights = rng.integers(1, 4, len(own)) / 4 if coarse else rng.random(len(own))
        out.append((int(k * 7 % n), own.tolist(), weights.tolist(), f"n{k * 7 % n}"))
    return out


def rows(frame):
    return sorted((r.query_id, r["rank"], r.item_id, round(r.score, 9), r.name) for r in frame.collect())


@pytest.mark.parametrize("coarse, shard, block", [(True, 10**6, 8192), (False, 300, 8192), (True, 300, 9)])
def test_search_equals_the_scan(spark, tmp_path, monkeypatch, coarse, shard, block):
    monkeypatch.setattr(postings, "BLOCK_ROWS", block)
    items = spark.createDataFrame(make(400, 60, 1, coarse), SCHEMA)
    asked = spark.createDataFrame(make(40, 60, 2, coarse), SCHEMA).select(F.col("item_id").alias("query_id"), "indices", "weights")
    postings.build(items, str(tmp_path / "i"), shard)
    index = postings.PostingIndex(spark, str(tmp_path / "i"))
    for k, decimals in ((5, 6), (500, None)):
        assert rows(index.search(asked, k, ["name"], decimals)) == rows(nearest(items, asked, k, "dot", ["name"], decimals))


def test_fewer_postings_are_scored_than_there_are(spark, tmp_path):
    """Rare terms of much weight settle the best, so common ones count for few items."""
    rng = np.random.default_rng(4)
    items = [(k, [0, 1, 2 + int(rng.integers(0, 40))], [0.1 * rng.random(), 0.1 * rng.random(), 0.9 + 0.1 * rng.random()], f"n{k}") for k in range(3000)]
    items = spark.createDataFrame(items, SCHEMA)
    asked = spark.createDataFrame([(q, [0, 1, 2 + q], [0.3, 0.3, 0.9]) for q in range(10)], "query_id long, indices array<int>, weights array<double>")
    postings.build(items, str(tmp_path / "i"), 3000)
    index = postings.PostingIndex(spark, str(tmp_path / "i"))
    assert rows(index.search(asked, 4, ["name"])) == rows(nearest(items, asked, 4, "dot", ["name"]))
    work = index.work(asked, 4).collect()
    assert len(work) == 10 and all(r.scored < r.postings / 5 and r.postings > 6000 for r in work)


def test_empty_tables_and_bad_weights(spark, tmp_path):
    items = spark.createDataFrame([(1, [0], [0.5], "n1"), (2, [], [], "n2")], SCHEMA)
    asked = items.select(F.col("item_id").alias("query_id"), "indices", "weights")
    postings.build(items, str(tmp_path / "i"))
    index = postings.PostingIndex(spark, str(tmp_path / "i"))
    assert rows(index.search(asked, 2, ["name"])) == [(1, 1, 1, 0.25, "n1"), (1, 2, 2, 0.0, "n2"), (2, 1, 1, 0.0, "n1"), (2, 2, 2, 0.0, "n2")]
    assert index.search(asked.where("false"), 2).count() == 0
    postings.build(items.where("false"), str(tmp_path / "none"))
    assert postings.PostingIndex(spark, str(tmp_path / "none")).search(asked, 2).count() == 0
    with pytest.raises(Exception, match="not be negative"):
        postings.build(spark.createDataFrame([(1, [0], [-0.5], "n")], SCHEMA), str(tmp_path / "bad"))


def test_items_and_not_postings_are_shuffled(spark, tmp_path, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    given, run = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, *a, **b: given.append(self.count()) or run(self, *a, **b))
    # Copies, items without terms and lists that are null.
    made = [*make(60, 20, 3, True), (7, [1, 2], [0.5, 0.0], "copy"), (7, [], [], "none"), (99, None, None, "null")]
    items = spark.createDataFrame(made, SCHEMA)
    postings.build(items, str(tmp_path / "p"), 50)
    assert given == [len(made)]
    stored = spark.read.parquet(str(tmp_path / "p" / "postings"))
    long = stored.where("term >= 0").select(F.inline(F.arrays_zip("item_ids", "weights")).alias("item_id", "weight"), "term")
    wanted = [(i, w, t) for i, terms, weights, _ in made for t, w in zip(terms or [], weights or [], strict=True) if w]
    assert sorted((r.item_id, r.weight, r.term) for r in long.collect()) == sorted(wanted)
    listed = stored.where("term = -1").select(F.explode("item_ids").alias("i")).collect()
    assert sorted(r.i for r in listed) == sorted(m[0] for m in made)
    assert stored.groupBy("shard", "term").count().where("count > 1").isEmpty()
