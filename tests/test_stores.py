import random

import numpy as np
import pytest

from rankloom.operators import containment, vector_store
from rankloom.operators.term_store import TermStore
from rankloom.operators.tfidf import TfidfIndex


def texts(seed, number):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(4000)]
    return [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(number)]


def frame(spark, rows):
    return spark.createDataFrame([(t,) for t in rows], "text string")


@pytest.mark.parametrize("limit", [7, 100_000])
def test_refit_equals_a_fit_on_all_texts(spark, tmp_path, limit):
    a, b, c = texts(1, 80), [*texts(2, 30), None, "", "a"], []
    store = TermStore(spark, str(tmp_path / "terms"))
    for number, rows in enumerate((a, b, c, a)):
        store.add(frame(spark, rows), "text", number)
    store.add(frame(spark, b), "text", 3)  # replaces the batch of that number
    assert store.fit(limit) == TfidfIndex.fit(frame(spark, a + b + b), "text", limit)
    every = store.counts().select("term").distinct().count()
    assert (store.candidates(limit).count() < every / 4) == (limit == 7)


def test_refit_joins_where_candidates_are_many(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("rankloom.operators.term_store.SENT", 0)
    store = TermStore(spark, str(tmp_path / "terms"))
    store.add(frame(spark, texts(3, 40)), "text", 0)
    assert store.fit(20) == TfidfIndex.fit(frame(spark, texts(3, 40)), "text", 20)


def test_empty_vocabulary(spark, tmp_path):
    store = TermStore(spark, str(tmp_path / "terms"))
    store.add(frame(spark, ["", None]), "text", 0)
    with pytest.raises(ValueError):
        store.fit()


def test_unfinished_batch_does_not_count(spark, tmp_path):
    store = TermStore(spark, str(tmp_path / "terms"))
    store.add(frame(spark, ["aa bb"]), "text", 0)
    store.counts().drop("batch").write.parquet(f"{store.path}/counts/batch=1")
    assert store.fit().totals == [1, 1, 1]


@pytest.mark.parametrize("q", [2, 3])
def test_containments_equal_all_pairs(spark, q):
    rng = random.Random(q)
    make = lambda n: ["".join(rng.choice("abÉ𝄞 ") for _ in range(rng.randint(0, 9))) for _ in range(n)]
    titles, names = [*make(60), None, "", "long " * 5000], [*make(80), None, "", "AB", "ab", "ong lon"]
    lower = lambda rows: {t.lower() for t in rows if t}
    want = {(t, n) for t in lower(titles) for n in lower(names) if t in n or n in t}
    asked = spark.createDataFrame([(t,) for t in titles], "title string")
    items = spark.createDataFrame(list(enumerate(names)), "item_id long, name string")
    found = containment.containments(asked, items, q=q)
    assert sorted(map(tuple, found.collect())) == sorted(want) and want
    assert "CartesianProduct" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()
    counted = {r.title: (r.n_items, r.first_item) for r in containment.items_of_titles(asked, items, q).collect()}
    for t in lower(titles):
        ids = [i for i, n in enumerate(names) if n and (t in n.lower() or n.lower() in t)]
        assert counted.get(t) == ((len(ids), min(ids)) if ids else None)
    assert containment.containments(asked.where("false"), items).count() == 0


def test_every_text_is_encoded_once(spark, tmp_path):
    path, calls = str(tmp_path / "vectors"), spark.sparkContext.accumulator(0)

    def load(fail=""):
        def encoder(batch):
            if fail and fail in batch:
                raise OSError("lost")
            calls.add(len(batch))
            return np.array([[len(t), t.count("a")] for t in batch], np.float32)

        return encoder

    rows = [f"{'a' * (i % 5)} text {i % 40}" for i in range(200)] + [None, "", ""]
    docs = frame(spark, rows)
    different = len({r or "" for r in rows})
    # The text of the last block fails; blocks before it are kept.
    last = max(vector_store_digests(spark, docs))[1]
    with pytest.raises(Exception, match="lost"):
        vector_store.add_missing(docs, "text", lambda: load(last), path, 4)
    kept = vector_store.stored(spark, path).count()
    assert 0 < kept < different
    assert vector_store.add_missing(docs, "text", load, path, 4) == different - kept
    before = calls.value
    found = vector_store.encode_stored(docs, "text", load, path, 4)
    assert sorted((r.text or "", list(r.vector)) for r in found.collect()) == sorted((t or "", [len(t or ""), (t or "").count("a")]) for t in rows)
    assert calls.value == before and vector_store.stored(spark, path).count() == different
    assert vector_store.encode_stored(docs.where("false"), "text", load, path).count() == 0


def vector_store_digests(spark, docs):
    return [tuple(r) for r in docs.where("text <> ''").selectExpr("sha2(text, 256)", "text").collect()]


def test_texts_are_dealt_by_size_before_terms_are_combined(spark, tmp_path, monkeypatch):
    from rankloom.operators import term_store

    tasks, term_counts = [], term_store.term_counts
    monkeypatch.setattr(term_store, "TASK_CHARS", 200, raising=False)
    monkeypatch.setattr(term_store, "term_counts", lambda corpus, text: tasks.append(corpus.rdd.getNumPartitions()) or term_counts(corpus, text))
    rows = [*texts(1, 60), None]
    store = TermStore(spark, str(tmp_path / "terms"))
    store.add(frame(spark, rows).coalesce(1), "text", 0)
    assert tasks[0] >= sum(len(t or "") for t in rows) / 200
    assert store.fit(20) == TfidfIndex.fit(frame(spark, rows), "text", 20)
