import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rankloom.llm import simhash


def brute_fingerprint(text, words=4):
    tokens = (text or "").encode().lower().split()
    shingles = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))] if tokens else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n", "a", "A b", "a B c d", "É é a b\tc\x0bd", "x " * 70_000, "\xa0 \x85 a b c d e f", " ".join(map(str, range(999)))])
def test_fingerprint(text):
    assert simhash.fingerprint(text) % 2**64 == brute_fingerprint(text)


def roots(fps, bits):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= bits) + i + 1:
            parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def clusters(seed, number):
    """Fingerprints in chains and balls around few centres, so that cells are full."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    found = [np.uint64(0), np.uint64(2**64 - 1), np.uint64(15)]
    for k in range(number):
        value = centres[k % 12] if k % 3 else found[rng.integers(len(found))]
        for bit in rng.choice(64, rng.integers(0, 8), replace=False):
            value ^= np.uint64(1) << np.uint64(bit)
        found.append(value)
    return np.unique(np.array(found, np.uint64))


@pytest.mark.parametrize("bits, limit", [(4, 4096), (4, 7), (5, 50), (0, 4096), (3, 20)])
def test_links_connect_all_classes(spark, bits, limit):
    fps = clusters(bits + limit, 500)
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").repartition(4)
    edges = simhash.links(frame, bits, limit)
    pairs = np.array([tuple(r) for r in edges.collect()], np.int64).reshape(-1, 2).view(np.uint64)
    assert (np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= bits).all()
    place = {int(x): i for i, x in enumerate(fps)}
    want = roots(fps, bits)
    named = {int(np.int64(r.node).view(np.uint64)): int(np.int64(r.root).view(np.uint64)) for r in simhash.components(edges).collect()}
    got = {}
    for x in fps.tolist():
        got.setdefault(named.get(x, x), set()).add(place[x])
    groups = {}
    for i, r in enumerate(want):
        groups.setdefault(r, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_vectors_two_steps_apart_share_a_cell():
    rng = np.random.default_rng(1)
    one = rng.integers(0, 2**63, 500, dtype=np.uint64)
    two = one.copy()
    for i in range(len(two)):
        for bit in rng.choice(64, rng.integers(0, 6), replace=False):
            two[i] ^= np.uint64(1) << np.uint64(bit)
    cells = [set(zip(*(x.tolist() for x in simhash.cells_of(f)))) for f in (one, two)]
    assert {r for r, _ in cells[0] & cells[1]} == set(range(500))


def test_long_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(1000, 900), (900, 1000), (900, 900)], "a long, b long"))
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    assert found == {**{i: 0 for i in range(1, 301)}, 1000: 900}
    assert simhash.components(edges.where("false")).count() == 0


def test_classes_and_keep_one(docs):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(5, text), (3, text.upper()), (3, text.upper()), (9, "quite another text of some words that is not like it"), (None, text), (7, None), (8, " "), (None, "alone in the world with null as id"), (2, "zz " * 50_000)]
    frame = docs(rows)
    found = simhash.classes(frame).collect()
    assert sorted(((r.doc_id or -1, r.component_id) for r in found), key=repr) == sorted([(5, 3), (3, 3), (3, 3), (9, 9), (-1, 3), (7, 7), (8, 7), (-1, None), (2, 2)], key=repr)
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 2, 3, 7, 9]
    assert simhash.keep_one(frame.where("false")).count() == 0 == simhash.classes(frame.where("false")).count()


def words(seed, number):
    return [f"w{x}" for x in np.random.default_rng(seed).integers(0, 10**6, number)]


def test_unlike_texts_without_an_id_or_under_one_id_all_stay(docs):
    one, two, three, four = (" ".join(words(k, 60)) for k in range(4))
    frame = docs([(None, one), (None, two), (None, two), (None, three), (7, three), (8, one.upper()), (8, four), (3, four), (7, None), (9, " ")])
    want = [(3, four), (7, None), (7, three), (8, one.upper()), (None, two)]
    assert sorted(((r.doc_id, r.text) for r in simhash.keep_one(frame).collect()), key=repr) == sorted(want, key=repr)
