"""Terms counted and weighed as codes, against plain Python and Spark's own vectors."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from rankloom.functions import coded
from rankloom.functions import text as tx
from rankloom.functions.tokens import spaced, with_terms
from rankloom.operators.tfidf import TfidfIndex
from rankloom.plans.catalog import fit_catalog

WORDS = ["alpha", "be", "Ça", "x", "œu_vre", "42", "ΣΑΣ", "日本", "7"]


def texts(seed, n):
    pick = random.Random(seed)
    made = [" - ".join(pick.choice(WORDS) for _ in range(pick.randint(0, 30))) for _ in range(n)]
    return [*made, "", " ", "x", "..x y..", "be be be be"]


def plain(rows):
    """(total, df) of every word and pair of blank-joined words."""
    total, held = Counter(), Counter()
    for row in rows:
        words = [w for w in row.split(" ") if len(w) > 1]
        terms = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        total.update(terms)
        held.update(set(terms))
    return {t: (n, held[t]) for t, n in total.items()}


@pytest.mark.parametrize("size, rows", [(1, 5), (40, 65536), (1 << 20, 3), (1 << 20, 65536)])
def test_parts_are_bounded_and_their_counts_add_up(monkeypatch, size, rows):
    monkeypatch.setattr(coded, "PART_BYTES", size)
    monkeypatch.setattr(coded, "PART_ROWS", rows)
    given = pa.array(["-", *(t.lower().replace(" - ", " ") for t in texts(1, 60))]).slice(1)
    cut = list(coded.parts(given))
    assert pa.concat_arrays(cut).to_pylist() == given.to_pylist()
    assert all(len(p) <= rows and (len(p) == 1 or sum(len(t.as_py().encode()) for t in p) <= size) for p in cut)
    found = {}
    for batch in coded.count_terms(given):
        for r in batch.to_pylist():
            old = found.get(r["term"], (0, 0))
            found[r["term"]] = old[0] + r["total"], old[1] + r["df"]
    assert found == plain(given.to_pylist())
    among = pa.array(["be", "42"])
    some = Counter()
    for batch in coded.count_terms(given, words=False, among=among):
        some.update({r["term"]: r["total"] for r in batch.to_pylist()})
    assert some == {t: n for t, (n, _) in found.items() if " " in t and set(t.split(" ")) <= {"be", "42"}}


def test_no_texts():
    empty = pa.array([], pa.string())
    assert list(coded.count_terms(empty)) == []
    assert len(coded.Weigher(["be"], [1.0])(empty)) == 0
    assert coded.Weigher(["be"], [1.0])(pa.array(["", "x"])).to_pylist() == [{"indices": [], "weights": []}] * 2


@pytest.mark.parametrize("limit", [3, 12, 500])
def test_vectors_are_those_of_the_ml_stages(spark, limit, monkeypatch):
    monkeypatch.setattr(coded, "PART_BYTES", 200)
    docs = spark.createDataFrame(list(enumerate([*texts(2, 50), None])), "item_id long, text string").repartition(3)
    index = TfidfIndex.fit(docs, "text", limit)
    out = with_terms(docs, "text", "_terms")
    for stage in (
        CountVectorizerModel.from_vocabulary(index.terms, inputCol="_terms", outputCol="_counts"),
        ElementwiseProduct(scalingVec=Vectors.dense(index.idf), inputCol="_counts", outputCol="_scaled"),
        Normalizer(p=2.0, inputCol="_scaled", outputCol="_unit"),
    ):
        out = stage.transform(out)
    want = {r.item_id: (r._unit.indices.tolist(), r._unit.values.tolist()) for r in out.collect()}
    found = index.transform(docs)
    assert found.columns == ["item_id", "text", "indices", "weights"]
    assert {r.item_id: (r.indices, r.weights) for r in found.collect()} == want
    lists = docs.select("item_id", spaced(F.col("text")).alias("words"))
    assert {r.item_id: (r.indices, r.weights) for r in index.transform_worded(lists).collect()} == want
    assert TfidfIndex.fit_worded(lists, limit) == index


def test_catalog_texts_are_cut_into_words_once(spark):
    rows = [(i, f"n{i}", "u", "General", t) for i, t in enumerate(texts(3, 20))]
    catalog = spark.createDataFrame(rows, "item_id long, name string, url string, item_type string, embedding_text string")
    index, items = fit_catalog(catalog)
    plan = items._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "lower(" not in plan
    plain_way = TfidfIndex.fit(catalog, "embedding_text")
    assert index == plain_way
    vectors = plain_way.transform(catalog, "embedding_text").drop("embedding_text")
    assert items.columns == vectors.columns
    assert sorted(items.collect()) == sorted(vectors.collect())


def test_embedding_text_has_single_blanks(spark):
    frame = spark.createDataFrame([("N", " a  b   c "), ("", ""), ("N", None), ("N", "d e")], "n string, d string")
    found = [r.t for r in frame.select(tx.embedding_text(F.col("n"), F.col("d")).alias("t")).collect()]
    assert found == ["N. a b c", ".", None, "N. d e"]
