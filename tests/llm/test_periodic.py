import hashlib
import os
import random
from fractions import Fraction
from zlib import crc32

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm import periodic


def brute_runs(words, least, times):
    """All runs by their definition: every period, every maximal stretch, the smallest period of it."""
    n, found = len(words), {}
    for p in range(1, n // times + 1):
        k = 0
        while k + p < n:
            if words[k] != words[k + p]:
                k += 1
                continue
            end = k
            while end + p < n and words[end] == words[end + p]:
                end += 1
            if end + p - k >= max(least, times * p):
                found.setdefault((k, end + p), p)
            k = end
    return sorted((a, b - a, p) for (a, b), p in found.items())


def brute_common(words, i, j, ahead):
    n = 0
    while 0 <= i and 0 <= j and i < len(words) and j < len(words) and words[i] == words[j]:
        n, i, j = n + 1, i + (1 if ahead else -1), j + (1 if ahead else -1)
    return n


def texts(rng, count):
    for _ in range(count):
        out = []
        for _ in range(rng.randint(1, 6)):
            unit = [rng.randint(0, rng.choice([1, 2, 5, 50])) for _ in range(rng.randint(1, 12))]
            out += unit * rng.randint(1, 9) + unit[: rng.randint(0, len(unit))]
        yield out


def test_extensions_are_those_of_plain_comparison():
    rng = random.Random(5)
    for words in texts(rng, 60):
        grammar = periodic.Grammar(np.array(words))
        pairs = np.array([(i, j) for i in range(len(words)) for j in range(i + 1, len(words))][::7] or [(0, 0)])
        if (pairs[:, 0] == pairs[:, 1]).any():
            continue
        for ahead in (True, False):
            got = grammar.common(pairs[:, 0], pairs[:, 1], ahead).tolist()
            assert got == [brute_common(words, i, j, ahead) for i, j in pairs.tolist()]


@pytest.mark.parametrize("least, times", [(24, 3), (2, 2), (1, 2), (7, 4)])
def test_runs_are_those_of_the_definition(least, times):
    rng = random.Random(least)
    group = [*texts(rng, 120), [], [1], [0] * 500, [0, 1] * 200 + [2] * 30, [0] * 23, [0] * 24]
    got = periodic.runs_of([np.array(w, np.int64) for w in group], least, times)
    for words, found in zip(group, got, strict=True):
        assert list(map(tuple, found.tolist())) == brute_runs(words, least, times)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1), max_size=40), max_size=4))
def test_runs_of_two_letters(group):
    got = periodic.runs_of([np.array(w, np.int64) for w in group], 3, 2)
    assert [list(map(tuple, r.tolist())) for r in got] == [brute_runs(w, 3, 2) for w in group]


def test_long_texts():
    """A run of one word, one of a long period, and a text without any, each of 400,000 words."""
    n = 400_000
    unit = np.arange(100_000)
    one, long, none = np.zeros(n, np.int64), np.tile(unit, 4), np.arange(n)
    got = [list(map(tuple, periodic.runs_of([x])[0].tolist())) for x in (one, long, none)]
    assert got == [[(0, n, 1)], [(0, n, 100_000)], []]


def test_levels_shrink():
    rng = np.random.default_rng(1)
    grammar = periodic.Grammar(np.tile(rng.integers(0, 50, 5000), 4))
    assert sum(map(len, grammar.levels)) < 12 * len(grammar.levels[0])


def expected(words, runs):
    keep = [not any(s + p <= k < s + n for s, n, p in runs) for k in range(len(words))]
    best = min(runs, key=lambda r: (Fraction(-r[1], r[2]), r[0], r[2]), default=None)
    return best, " ".join(w for w, k in zip(words, keep, strict=True) if k)


def test_frames(spark, docs):
    rows = [(None, None), (None, " \t\n"), (3, "x " * 30), (3, "x " * 30), (4, "a\x85b c\x0bd"), (5, ("ü v\n" * 40) + "end " + "p q r " * 9)]
    frame = docs(rows).withColumnRenamed("key", "runs").withColumnRenamed("_first", "passed")
    made = periodic.find_runs(frame)
    assert made.columns == ["doc_id", "lang", "source", "n_chars", "passed", "n_words", "runs", "best", "collapsed"]
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.best and tuple(r.best), r.collapsed) for r in made.collect()]
    want = []
    for i, t in rows:
        words = [w.decode() for w in (t or "").encode().split()]
        runs = brute_runs(words, 24, 3)
        want.append((i, len(words), runs, *expected(words, runs)))
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert periodic.find_runs(frame.where("false")).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables not present")
def test_query(spark):
    from rankloom.llm.queries import QUERIES

    found = {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_periodic_runs"](spark, "/root/testdata/sf0.001").collect()}
    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    planted = 0
    for d in docs:
        words = [w.decode() for w in (d["text"] or "").encode().split()]
        n, h = len(words), crc32(str(d["doc_id"]).encode())
        if h % 10 == 0 and n:
            planted += 1
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[k if k < a else a + (k - a) % p] for k in range(n)]
        runs = brute_runs(words, 24, 3)
        best, rest = expected(words, runs)
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in sorted(runs, key=lambda r: (r[0], r[2])))
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (listed, rest)]
        nulls = (None,) * 4
        assert found[d["doc_id"]] == (len(runs), *((*best, 1000 * best[1] // best[2]) if best else nulls), *digests)
    assert planted > 5 and len(found) == len(docs)
