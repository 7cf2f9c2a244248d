import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from rankloom.operators import rank, vectors
from rankloom.operators.tfidf import TfidfIndex, retrieve, term_counts
from rankloom.operators.topk import nearest

# Functions given to tasks from here travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ITEMS = "item_id long, vector array<float>, item_type string, name string"


def make(n, dim, seed, kinds=("A", "b", None)):
    rng = np.random.default_rng(seed)
    # Coarse values, so equal scores occur and ties matter.
    matrix = rng.integers(-2, 3, (n, dim)).astype(float)
    return [(int(i * 7 % n), [float(x) for x in row], kinds[i % len(kinds)], f"n{i * 7 % n}") for i, row in enumerate(matrix)]


def brute(items, queries, k, metric):
    out = {}
    for qid, qv, wish in queries:
        scored = []
        for iid, iv, kind, _ in items:
            if wish not in (None, "") and wish.lower() != "all" and (kind or "").lower() != wish.lower():
                continue
            a, b = np.array(qv), np.array(iv)
            if metric == "l2":
                score = -float(((a - b) ** 2).sum())
            else:
                score = float(a @ b)
                if metric == "cosine":
                    norm = np.sqrt((a @ a) * (b @ b))
                    score = score / norm if norm else 0.0
            scored.append((-round(score * 1e6), iid))
        out[qid] = [i for _, i in sorted(scored)[:k]]
    return out


def ranked(frame):
    got = {}
    for r in frame.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.item_id)
        assert r["name"] == f"n{r.item_id}"
    return got


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
@pytest.mark.parametrize("sizes", [{}, {"block_rows": 7}])
def test_nearest_matches_brute_force(spark, metric, sizes):
    items = make(203, 4, 1)
    queries = [(i, v, [None, "a", "B", "ALL", "", "none"][i % 6]) for i, v, _, _ in make(31, 4, 2)]
    frame = spark.createDataFrame(items, ITEMS).repartition(5)
    asked = spark.createDataFrame(queries, "query_id long, vector array<float>, query_type string")
    got = ranked(nearest(frame, asked, 6, metric, payload=["name"], **sizes))
    want = {q: ids for q, ids in brute(items, queries, 6, metric).items() if ids}
    assert got == want


def test_items_ask_about_themselves_in_blocks(spark):
    items = spark.createDataFrame(make(120, 4, 8), ITEMS)
    asked = items.select(F.col("item_id").alias("query_id"), "vector", F.col("item_type").alias("query_type"))
    plain = nearest(items, asked, 5, payload=["name"])
    blocks = nearest(items, asked, 5, payload=["name"], block_rows=50)
    assert sorted(plain.collect()) == sorted(blocks.collect())


def test_items_and_queries_without_vector_are_left_out(spark):
    items = spark.createDataFrame([(1, [1.0], "A", "n1"), (2, None, "A", "n2"), (3, [0.5], "A", "n3")], ITEMS)
    asked = items.select(F.col("item_id").alias("query_id"), "vector")
    assert ranked(nearest(items, asked, 5, payload=["name"])) == {1: [1, 3], 3: [1, 3]}


def test_nearest_with_fewer_items_than_k_and_no_items(spark):
    items = spark.createDataFrame(make(3, 4, 1), ITEMS)
    asked = items.select(F.col("item_id").alias("query_id"), "vector")
    assert nearest(items, asked, 10).count() == 9
    assert nearest(items.where("item_id < 0"), asked, 10, payload=["name"]).count() == 0
    with pytest.raises(ValueError):
        nearest(items, asked, 0)


def test_many_batches_keep_the_payload_of_winners(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        items = make(400, 3, 5)
        queries = [(i, v, None) for i, v, _, _ in make(9, 3, 6)]
        frame = spark.createDataFrame(items, ITEMS).coalesce(1)
        asked = spark.createDataFrame(queries, "query_id long, vector array<float>, query_type string")
        got = ranked(nearest(frame, asked.drop("query_type"), 5, payload=["name"]))
        assert got == brute(items, queries, 5, "cosine")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_filter_before_and_after_the_cut_differ(spark):
    """A type found only below rank 2k: the dense path returns it, the pooled path does not."""
    rows = [(i, [1.0, i / 10], "common" if i < 8 else "rare", f"n{i}") for i in range(10)]
    items = spark.createDataFrame(rows, ITEMS).withColumn("url", F.lit("u"))
    asked = spark.createDataFrame([(1, [1.0, 0.0], "RARE", 2)], "query_id long, vector array<float>, query_type string, k int")
    dense = vectors.recommend_dense(items, asked, 2)
    assert [r.item_id for r in dense.orderBy("rank").collect()] == [8, 9]
    pool = nearest(items, asked.select("query_id", "vector"), 20, payload=["item_type"])
    assert rank.overfetch(pool, asked).count() == 0


def test_items_without_type_are_left_out(spark):
    items = spark.createDataFrame(make(30, 4, 3), ITEMS).withColumn("url", F.lit("u"))
    asked = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 1.0])], "query_id long, vector array<float>")
    found = vectors.recommend_dense(items, asked, 30)
    assert found.count() == 20 and found.where("item_type is null").count() == 0


def test_neighbours_leave_out_the_item_but_not_its_copy(spark):
    rows = [(i, [1.0, 0.0], "A", f"n{i}") for i in range(8)] + [(9, [0.0, 1.0], "A", "n9")]
    items = spark.createDataFrame(rows, ITEMS)
    got = ranked(vectors.neighbours(items, items, 5, payload=["name"]))
    assert got[0] == [1, 2, 3, 4, 5] and got[7] == [0, 1, 2, 3, 4] and got[9] == [0, 1, 2, 3, 4]


def test_salted_top_rows_are_the_same(spark):
    frame = spark.range(5000).select("id", (F.col("id") % 3).alias("g"), (F.hash("id") % 50).alias("v"))
    order = [F.col("v").desc(), F.col("id")]
    plain = rank.top_rows(frame, ["g"], order, 7, salts=1).orderBy("g", "rank").collect()
    salted = rank.top_rows(frame.repartition(9), ["g"], order, 7, salts=4).orderBy("g", "rank").collect()
    assert plain == salted


TEXTS = [
    (1, "red fish blue fish", "x"),
    (2, "Blue bird", "x"),
    (3, "", "y"),
    (4, None, "y"),
    (5, "red red bird bird", None),
    (6, "old cat", "y"),
]


def plain_tfidf(texts, limit):
    import math
    import re
    from collections import Counter

    def terms(t):
        w = re.findall(r"\w\w+", (t or "").lower())
        return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])

    docs = {i: terms(t) for i, t, _ in texts}
    total = sum(docs.values(), Counter())
    vocab = sorted(total, key=lambda t: (-total[t], t))[:limit]
    df = {t: sum(t in d for d in docs.values()) for t in vocab}
    idf = {t: math.log((1 + len(docs)) / (1 + df[t])) + 1 for t in vocab}

    def vector(t):
        w = {x: c * idf[x] for x, c in terms(t).items() if x in idf}
        norm = math.sqrt(sum(v * v for v in w.values()))
        return {x: v / norm for x, v in w.items()} if norm else {}

    return total, df, vector


@pytest.mark.parametrize("limit", [6, 8000])
def test_tfidf_matches_plain_python(spark, limit):
    corpus = spark.createDataFrame(TEXTS, "item_id long, text string, item_type string")
    total, df, vector = plain_tfidf(TEXTS, limit)
    counts = {r.term: (r.total, r.df) for r in term_counts(corpus, "text").collect()}
    assert {t: c[0] for t, c in counts.items()} == dict(total)
    index = TfidfIndex.fit(corpus, "text", limit)
    assert dict(zip(index.terms, index.dfs)) == df
    got = {}
    for r in index.weights(corpus, "item_id").collect():
        got.setdefault(r.item_id, {})[r.term] = r.weight
    for i, t, _ in TEXTS:
        assert got.get(i, {}) == pytest.approx(vector(t))


def test_retrieve_pads_with_zero_scores_by_id(spark):
    corpus = spark.createDataFrame(TEXTS, "item_id long, text string, item_type string")
    index = TfidfIndex.fit(corpus, "text")
    asked = spark.createDataFrame([(1, "a bird"), (2, "unheard of"), (3, None)], "query_id long, query string")
    found = retrieve(index, index.transform(corpus), asked, 4)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.item_id, round(r.score, 6)))
    # Item 5 has no type and is no candidate, though its words count.
    assert [i for i, _ in got[1]] == [2, 1, 3, 4] and got[1][0][1] > 0
    assert got[2] == got[3] == [(1, 0.0), (2, 0.0), (3, 0.0), (4, 0.0)]


def test_index_is_saved_and_loaded(spark, tmp_path):
    corpus = spark.createDataFrame(TEXTS, "item_id long, text string, item_type string")
    index = TfidfIndex.fit(corpus, "text", 7)
    index.save(spark, str(tmp_path / "v"))
    assert TfidfIndex.load(spark, str(tmp_path / "v")) == index


def test_empty_vocabulary_is_an_error(spark):
    with pytest.raises(ValueError):
        TfidfIndex.fit(spark.createDataFrame([(1, "a b c")], "item_id long, text string"), "text")


def _tiny_encoder():
    return lambda texts: np.array([[len(t), t.count("a")] for t in texts])


def test_encode_and_search(spark):
    rows = [(i, "a" * i + "b" * (10 - i), f"n{i}", "T", "u") for i in range(11)]
    items = spark.createDataFrame(rows, "item_id long, text string, name string, item_type string, url string")
    encoded = vectors.encode(items, "text", _tiny_encoder, batch_size=3)
    assert encoded.where(F.size("vector") == 2).count() == 11
    stats = vectors.vector_stats(encoded).first()
    assert (stats.n_rows, stats.dimension, stats.size_mb) == (11, 2, 11 * 2 * 4 / 1048576)
    asked = spark.createDataFrame([(1, "aaaaaaabbb")], "query_id long, query string")
    found = vectors.text_search(encoded, asked, _tiny_encoder, 3).orderBy("rank").collect()
    assert found[0].item_id == 7 and len(found) == 3 and found[0]["name"] == "n7"


def test_sample_is_capped_and_repeatable(spark):
    items = spark.range(4).select(F.col("id").alias("item_id"))
    assert vectors.sample_items(items, 9).count() == 4
    assert vectors.sample_items(items, 2).collect() == vectors.sample_items(items.repartition(3), 2).collect()


def l2(spark, items, query, k, **more):
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(items)], "item_id long, vector array<double>")
    asked = spark.createDataFrame([(0, [float(x) for x in query])], "query_id long, vector array<double>")
    return [(r.item_id, r.distance) for r in vectors.l2_nearest(frame, asked, k, **more).orderBy("rank").collect()]


def test_large_distances_keep_every_place(spark):
    assert [i for i, _ in l2(spark, [[4e6], [0], [5e6]], [0], 3)] == [1, 0, 2]
    assert [i for i, _ in l2(spark, [[0], [1e6], [2e6], [3e6], [4e6], [5e6]], [0], 5, decimals=6)] == [0, 1, 2, 3, 4]


def test_small_distances_are_told_apart(spark):
    assert [i for i, _ in l2(spark, [[5e-4], [4e-4], [0], [1e-4]], [0], 2)] == [2, 3]


def test_near_points_far_from_the_origin(spark):
    found = l2(spark, [[1e6 + 0.002], [1e6 + 0.001], [1e6]] + [[1e6 + j] for j in range(1, 60)], [1e6], 3)
    assert [i for i, _ in found] == [2, 1, 0]
    assert found[1][1] == pytest.approx(1e-6, rel=1e-3)


def test_scores_that_are_not_finite_are_an_error(spark):
    for bad in (float("nan"), float("inf"), 1e200):
        with pytest.raises(Exception, match="finite scores"):
            l2(spark, [[bad], [1.0]], [0.0], 1)


def test_each_text_is_encoded_once_in_blocks(spark):
    calls = spark.sparkContext.accumulator(0)

    def load():
        def run(texts):
            calls.add(len(texts))
            return np.array([[len(t), t.count("a") + 1.0] for t in texts])

        return run

    texts = spark.createDataFrame([(i, "a" * (i % 5) + "b" * i, f"n{i}", "A", "u") for i in range(60)], "item_id long, query string, name string, item_type string, url string")
    items = vectors.encode(texts, "query", load)
    asked = vectors.encode(texts.select(F.col("item_id").alias("query_id"), "query"), "query", load).checkpoint()
    assert nearest(items, asked.select("query_id", "vector"), 3, block_rows=20).count() == 180
    assert calls.value == 120
    vectors.text_search(items, texts.select(F.col("item_id").alias("query_id"), "query"), load, 3).collect()
    assert calls.value == 240


def test_many_blocks_of_queries_never_reach_the_driver(spark, monkeypatch):
    """With more queries than a block holds, no Arrow table or list of rows with vectors is collected."""
    from pyspark.sql.classic.dataframe import DataFrame

    items = make(300, 5, 8)
    frame = spark.createDataFrame(items, ITEMS).repartition(4)
    asked = frame.select(F.col("item_id").alias("query_id"), "vector", F.lit(None).cast("string").alias("query_type")).checkpoint()
    whole = ranked(nearest(frame, asked, 4, payload=["name"]))
    seen = []
    for name in ("toArrow", "collect", "toPandas"):
        known = getattr(DataFrame, name)
        monkeypatch.setattr(DataFrame, name, lambda self, *a, known=known, **b: (seen.append(self.columns), known(self, *a, **b))[1])
    found = nearest(frame, asked, 4, payload=["name"], block_rows=50)
    assert not [c for columns in seen for c in columns if c in ("vector", "query", "item")]
    monkeypatch.undo()
    assert ranked(found) == whole
    assert "BroadcastExchange" not in found._jdf.queryExecution().toString()


def test_sparse_queries_in_many_blocks(spark):
    texts = [(i, f"alpha{i % 7} beta{i % 11} gamma", "t", f"n{i}") for i in range(60)]
    docs = spark.createDataFrame(texts, "item_id long, text string, item_type string, name string")
    index = TfidfIndex.fit(docs, "text")
    items = index.transform(docs)
    asked = items.select(F.col("item_id").alias("query_id"), "indices", "weights")
    few, many = (nearest(items, asked, 5, "dot", payload=["name"], decimals=6, block_rows=n) for n in (1000, 13))
    assert ranked(few) == ranked(many)


def _random_items(spark, vectors):
    return spark.createDataFrame([(k, [float(x) for x in v], f"n{k}") for k, v in enumerate(vectors)], "item_id long, vector array<double>, name string")


@pytest.mark.parametrize("stack", [16384, 30])
def test_items_are_copied_once_a_stack_and_not_once_a_block(spark, monkeypatch, stack):
    from rankloom.operators import topk

    copies, score_cells = [], topk.score_cells
    monkeypatch.setattr(topk, "STACK_ROWS", stack)
    monkeypatch.setattr(topk, "score_cells", lambda asked, given, *a: copies.append(given.count()) or score_cells(asked, given, *a))
    items = _random_items(spark, np.random.default_rng(5).normal(size=(200, 4)))
    asked = items.select(F.col("item_id").alias("query_id"), "vector")
    found = nearest(items, asked, 3, block_rows=5, decimals=6)
    # Of 40 blocks of five queries: one stack, or as many as balance the copies.
    assert copies == [200 if stack > 200 else 800]
    few = nearest(items, asked, 3, decimals=6)
    rounded = ["query_id", "item_id", F.round("score", 6), "rank"]
    assert sorted(found.select(*rounded).collect()) == sorted(few.select(*rounded).collect())


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
@pytest.mark.parametrize("scale, offset, decimals", [(1.0, 0.0, 6), (1e7, 0.0, None), (1e-5, 0.0, None), (1.0, 1e5, None), (1.0, 0.0, 1)])
def test_few_pairs_are_scored_in_full(monkeypatch, metric, scale, offset, decimals):
    import pyarrow as pa

    from rankloom.operators import topk

    scored, rank_key = [], topk.rank_key
    monkeypatch.setattr(topk, "rank_key", lambda score, d: scored.append(np.size(score)) or rank_key(score, d))
    rng = np.random.default_rng(6)
    values = offset + scale * rng.normal(size=(12_000, 16))
    values[100:140] = values[7]
    values[9000] = 0
    ids = rng.permutation(12_000)
    lists = pa.array(list(values), pa.list_(pa.float64()))
    asked = pa.table({"query_id": ids[:300], "vector": lists.slice(0, 300), "wanted": pa.nulls(300, pa.string())})
    scorer = topk.Scorer.of(asked, 7, metric, [], decimals)
    for at in range(0, 12_000, 4000):
        scorer.add(pa.record_batch({"item_id": ids[at : at + 4000], "vector": lists.slice(at, 4000)}))
    pairs = sum(scored)
    found = sorted((r["query_id"], -r["score_key"], r["item_id"]) for table in scorer.result() for r in table.to_pylist())
    wanted = []
    length = np.sqrt((values**2).sum(axis=1))
    for q in range(300):
        if metric == "l2":
            score = -((values - values[q]) ** 2).sum(axis=1)
        else:
            score = values @ values[q]
            if metric == "cosine":
                norm = length * length[q]
                score = score / np.where(norm == 0, 1.0, norm)
        key = rank_key(score, decimals)
        order = np.lexsort((ids, -key))[:7]
        wanted += [(ids[q], -key[i], ids[i]) for i in order]
    wanted.sort()
    assert [(q, i) for q, _, i in found] == [(q, i) for q, _, i in wanted]
    assert np.allclose([k for _, k, _ in found], [k for _, k, _ in wanted], rtol=1e-9, atol=1e-12)
    if offset == 0 and decimals != 1:
        assert pairs < 0.1 * 300 * 12_000
