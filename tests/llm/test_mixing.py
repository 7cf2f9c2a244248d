import os
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from rankloom.llm import mixing
from rankloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    """The targets by their definition: share, cut at the limit, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, left, free = {s: 0.0 for s in sizes}, float(sum(sizes.values())), set(sizes)
    while free and left > 1e-9:
        share, over, total = left, 0.0, sum(weight[s] for s in free)
        for s in list(free):
            target[s] += share * weight[s] / total
            if target[s] >= most * sizes[s]:
                over += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                free.discard(s)
        left = over
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {rng.choice(["", "é", "Z", "z", "src"]) + str(k): rng.choice([0, 1, 10, 1000, 100_000]) for k in range(3 + 40 * seed)} | {None: 50}
    frame = spark.createDataFrame([(s, 1, n) for s, n in sizes.items()], "source string, docs long, source_size long")
    found = {r.source: r.target for r in mixing.targets(frame).collect()}
    want = brute_targets(sizes)
    assert found.keys() == want.keys() and all(abs(found[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


@pytest.mark.parametrize("keep", [0, 1, 16])
def test_settling_keeps_the_sum_and_leaves_small_ones(keep):
    rng = np.random.default_rng(keep)
    for trial in range(60):
        n = int(rng.integers(1, 300))
        size = -np.sort(-rng.integers(1, [3, 100, 20_000][trial % 3], n))
        x = np.full(n, rng.random()) if trial % 2 else rng.random(n)
        x[: n // 10] = 1.0
        before, start = (size * x).sum(), x.copy()
        mixing.settle(size, x, keep, rng)
        open_ = np.flatnonzero((x > 0) & (x < 1))
        assert len(open_) <= keep and (x >= 0).all() and (x <= 1).all()
        assert (x[(start == 0) | (start == 1)] == start[(start == 0) | (start == 1)]).all()
        assert abs((size * x).sum() - before) <= (size.max() if keep == 0 else 1e-4)


def test_every_row_keeps_its_probability():
    size, want = np.array([900, 400, 399, 50, 50, 3, 1]), np.array([0.3, 0.3, 0.9, 0.5, 0.01, 0.7, 0.2])
    seen = np.zeros(len(size))
    for seed in range(6000):
        x = want.copy()
        mixing.settle(size, x, 0, np.random.default_rng(seed))
        seen += x
    assert np.abs(seen / 6000 - want).max() < 0.03


def test_large_groups_go_through_in_pieces_and_levels(spark, monkeypatch):
    rows = [(k, "hot" if k % 3 else f"s{k % 7}", 1 + (k * 7919) % 500) for k in range(6000)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, size long")
    found = {}
    for leaf in (32, 4096):  # two levels of nodes above the leaves, and none
        monkeypatch.setattr(mixing, "LEAF", leaf)
        got = mixing.mix(frame).collect()
        assert sorted(r.doc_id for r in got) == list(range(6000))
        words = {}
        for r in got:
            assert 0 <= r.copies <= 3
            words.setdefault(r.source, [0, r.target])[0] += r.copies * r["size"]
        assert all(abs(taken - target) <= 500 for taken, target in words.values())
        assert abs(words["hot"][0] - words["hot"][1]) <= 5
        found[leaf] = got
    assert sorted(map(repr, mixing.mix(frame.repartition(3)).collect())) == sorted(map(repr, found[4096]))


def test_groups_larger_than_a_task_holds(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 10**9)
    frame = spark.range(40_000).selectExpr("id as doc_id", "if(id % 2 = 0, 'a', 'b') as source", "1 + id % 97 as size")
    got = mixing.mix(frame).groupBy("source").agg({"target": "max", "*": "count"}).collect()
    taken = {r[0]: r[1] for r in mixing.mix(frame).selectExpr("source", "copies * size as taken").groupBy("source").sum("taken").collect()}
    assert {r["count(1)"] for r in got} == {20_000} and all(abs(taken[r.source] - r["max(target)"]) <= 97 for r in got)


def test_nulls_repeated_rows_names_and_empty_tables(spark, docs):
    text = "w " * 10
    frame = docs([(None, None), (None, text), (2, ""), (3, text), (3, text), (3, text)]).withColumnRenamed("key", "copies").withColumnRenamed("_first", "passed")
    made = mixing.mix(mixing.with_size(frame))
    assert made.columns == ["doc_id", "lang", "source", "n_chars", "passed", "size", "source_size", "target", "copies"]
    got = made.collect()
    assert len(got) == 6 and all(r.copies == 0 for r in got if not r["size"])
    assert mixing.mix(mixing.with_size(frame.where("false"))).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_query(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    sizes, own = {}, {}
    for d in docs:
        n = len((d["text"] or "").encode().split())
        own[d["doc_id"]] = n, d["source"]
        sizes[d["source"]] = sizes.get(d["source"], 0) + n
    want, taken = brute_targets(sizes), dict.fromkeys(sizes, 0)
    found = QUERIES["op13_source_mix"](spark, SF).collect()
    for r in found:
        n, source = own[r.doc_id]
        assert (r["size"], r.source_size) == (n, sizes[source]) and abs(r.target - want[source]) < 1e-6 * want[source]
        assert r.taken <= 3 * n and (not n or r.taken % n == 0)
        taken[source] += r.taken
    assert len(found) == len(docs)
    largest = {s: max(n for n, t in own.values() if t == s) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    assert sorted(map(repr, QUERIES["op13_source_mix"](spark, SF).collect())) == sorted(map(repr, found))
