import random

import numpy as np
import pytest

from rankloom.llm import tiling


def covered(item, text, least=5):
    found = list(tiling.Items([(1, item)], least).matches(text))
    return sum(t[2] for t in found[0][2]) if found else 0


def brute_tiles(item, doc, least):
    """Greedy tiling by its definition: the longest unmarked match again and again."""
    a, b, tiles = [False] * len(item), [False] * len(doc), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not a[i + n] and not b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return tiles
        n, i, j = best
        a[i : i + n] = b[j : j + n] = [True] * n
        tiles.append((i, j, n))


@pytest.mark.parametrize("seed", range(60))
def test_tiles_are_those_of_the_definition(seed):
    rng = random.Random(seed)
    item = np.array([rng.randint(1, 3 + seed % 5) for _ in range(rng.randint(3, 40))])
    doc = np.array([rng.randint(1, 3 + seed % 5) for _ in range(rng.randint(0, 60))])
    got, want = tiling.tile(item, doc, 3, 1 + seed % 9), brute_tiles(item, doc, 3)
    assert sorted(n for *_, n in got) == sorted(n for *_, n in want)
    for i, j, n in got:
        assert (item[i : i + n] == doc[j : j + n]).all()


def test_reordered_passages_are_covered():
    item = "One two three four five six. Seven eight nine ten eleven twelve. A b c d e f g."
    assert covered(item, "x y z. A b c, d e f g! Noise here. Seven eight NINE ten eleven twelve; one two three four five six") == 19
    assert covered(item, "one two three four and seven eight nine ten") == 0
    assert covered(item, None) == covered(item, "") == covered("a b", "a b") == 0


SCHEMA = "doc_id long, text string, item_id long, tiles string, shared long"


def test_matches_and_clean(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [
        (1, f"Start {item} end", 9, "x", 1), (1, f"Start {item} end", 9, "x", 1), (2, "alpha beta gamma delta epsilon only half here", 1, "", 2),
        (3, "nothing of it", 1, "", 3), (4, None, None, None, None), (5, "", 1, "", 0), (None, f"{item} {item}", 1, "", 0), (7, "w " * 60_000 + item, 1, "", 0),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    benchmark = spark.createDataFrame([(1, item, "a"), (2, item, "b"), (3, None, "c"), (None, "too short", "d"), (5, "", "")], "item_id long, text string, doc_id string")
    for size in (16 << 20, 30):
        found = sorted((r.doc_id or 0, r.item_id, r.covered_words, r.item_words) for r in tiling.matches(docs, benchmark, block_bytes=size).collect())
        assert found == sorted((d, i, c, 10) for d, c in ((1, 10), (1, 10), (2, 5), (0, 10), (7, 10)) for i in (1, 2))
        kept = tiling.clean(docs, benchmark, 0.8, block_bytes=size)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5]
    assert tiling.matches(docs, benchmark.where("false")).count() == 0
    assert tiling.clean(docs.where("false"), benchmark).count() == 0
