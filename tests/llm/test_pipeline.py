"""The pipeline against a plain version of every stage, and the queries against theirs."""

import hashlib
import os

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from test_repeats import brute
from test_simhash import brute_fingerprint, roots
from tokenizers import Tokenizer

import corpus_pipeline
from rankloom.llm import quality_trees, tiling
from rankloom.llm.queries import ORACLES, QUERIES, quality_forest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def rows_of(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def covers(item, text):
    found = list(tiling.Items([(0, item)], 5).matches(text))
    return bool(found) and 2 * sum(t[2] for t in found[0][2]) >= found[0][1]


def test_pipeline(spark):
    forest = quality_forest(spark, SF)
    docs = rows_of("documents")
    scores = forest.score(quality_trees.statistics([(d["text"] or "").encode() for d in docs]))
    docs = [d for d, s in zip(docs, scores) if s >= 0.3]
    docs = one_of_each_class(docs)
    for d, (_, _, _, kept) in zip(docs, brute([d["text"] for d in docs], 200)):
        d["text"] = kept.decode("utf-8", "ignore")
    items = [b["text"] for b in rows_of("benchmark")]
    docs = [d for d in docs if not any(covers(i, d["text"]) for i in items)]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d["doc_id"]: library.encode(d["text"], add_special_tokens=False).ids for d in docs}
    found = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.ids for r in found} == want and all(r.exact for r in found) and len(found) == len(want)


def test_stages_keep_the_columns_of_documents(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    extra = frame.limit(20).withColumn("text", frame["text"])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, extra, SF).columns == corpus_pipeline.COLUMNS, name
    assert corpus_pipeline.STAGES[-1][1](spark, frame.where("false"), SF).count() == 0


def test_stages_take_empty_tables_nulls_and_repeated_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (None, "", None, "s", 0), (2, "plain words here " * 30, "en", "s", 510), (2, "plain words here " * 30, "en", "s", 510)]
    frame = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame, SF).count() >= 1, name
        assert stage(spark, frame.where("false"), SF).count() == 0, name


def test_query_of_chat_and_bpe(spark):
    from test_chat import expected

    turns = {}
    for r in sorted(rows_of("conversations"), key=lambda r: r["turn"]):
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    turns[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    found = {r.conv_id: tuple(r)[1:5] for r in QUERIES["op1_chat_round_trip"](spark, SF).collect()}
    assert found == {c: expected(t) for c, t in turns.items()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = {r.doc_id: tuple(r)[1:] for r in QUERIES["op6_bpe_round_trip"](spark, SF).collect()}
    for d in rows_of("documents"):
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        assert found[d["doc_id"]] == (len(ids), *digests)


def test_query_of_tiles_and_repeats(spark):
    docs, items = rows_of("documents"), rows_of("benchmark")
    found = {(r.doc_id, r.item_id) for r in QUERIES["op2_benchmark_tiles"](spark, SF).collect()}
    assert found == {(d["doc_id"], i["item_id"]) for d in docs for i in items if covers(i["text"], d["text"])}
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op4_maximal_repeats"](spark, SF).collect()}
    want = brute([d["text"] for d in docs], 200)
    assert found == {d["doc_id"]: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for d, w in zip(docs, want)}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    import duckdb

    link = duckdb.connect()
    for table in ("documents", "pages"):
        link.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = link.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in QUERIES[name](spark, SF).select(*names).collect())


def test_one_query_for_every_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def one_of_each_class(docs):
    """The document of the smallest id of each class of fingerprints at most four bits apart, by all pairs."""
    fps = np.array([brute_fingerprint(d["text"]) for d in docs], np.uint64)
    different = np.unique(fps)
    classes = dict(zip(different.tolist(), roots(different, 4), strict=True))
    first = {}
    for d, fp in sorted(zip(docs, fps.tolist(), strict=True), key=lambda x: x[0]["doc_id"]):
        first.setdefault(classes[fp], d)
    return sorted(first.values(), key=lambda d: d["doc_id"])


def test_near_duplicates_stage(spark):
    """The stage keeps what all pairs of fingerprints say, with the texts of the documents it keeps."""
    want = [(d["doc_id"], d["text"]) for d in one_of_each_class(rows_of("documents"))]
    found = corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()
    assert sorted((r.doc_id, r.text) for r in found) == want
