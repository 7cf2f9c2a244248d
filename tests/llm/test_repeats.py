import collections
import random

import numpy as np
import pytest

from rankloom.llm import repeats


def brute(texts, length):
    """(n_bytes, n_removed, n_spans, kept) of every text, by counting all windows."""
    data = [(t or "").encode() for t in texts]
    often = collections.Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if often[b[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[:-1]
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


def removed(frame, *args):
    rows = repeats.without_repeats(frame, *args).collect()
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows)


def messy(seed, number):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé ") for _ in range(60)) for _ in range(12)]
    texts = []
    for _ in range(number):
        parts = []
        for _ in range(rng.randint(0, 6)):
            at = rng.randint(0, 30)
            parts += rng.choice(base)[at : at + rng.randint(5, 60)], "".join(rng.choice("abc") for _ in range(rng.randint(0, 8)))
        texts.append("".join(parts))
    return [*texts, None, "", "a" * 300, "ab" * 200, "ab" * 90, texts[0], texts[0], "x" * 19, "x" * 20]


@pytest.mark.parametrize("length, limit", [(20, 32768), (33, 2), (16, 1)])
def test_equals_counting_all_windows(docs, length, limit):
    texts = messy(length, 80)
    want = [(i, *row) for i, row in enumerate(brute(texts, length))]
    assert removed(docs(list(enumerate(texts))).repartition(3), length, limit) == want


def test_long_texts_are_cut_into_pieces(docs, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 1 << 10)
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    fresh = ["".join(rng.choice("abcdefgh ") for _ in range(4000)) for _ in range(3)]
    texts = [fresh[0] + passage, passage[:2500] + fresh[1], fresh[2]]
    scanner = repeats.Scanner(200)
    data = np.frombuffer(texts[0].encode(), np.uint8)
    piece, at, low, high, *_ = scanner.anchors(data, np.array([0]), np.array([len(data)]))
    assert sum(high - low + 1) == len(data) - 199
    want = [(i, *row) for i, row in enumerate(brute(texts, 200))]
    assert removed(docs(list(enumerate(texts)))) == want


def test_repeated_rows_nulls_and_other_columns(docs):
    text = "".join(random.Random(1).choice("abcdef") for _ in range(400))
    frame = docs([(1, text), (1, text), (None, text), (4, None), (5, "short")])
    found = repeats.without_repeats(frame)
    assert found.columns == [*frame.columns, "n_bytes", "n_removed", "n_spans", "kept"]
    rows = found.collect()
    assert sorted((r.doc_id or 0, r.n_removed, r.n_spans) for r in rows) == [(0, 400, 1), (1, 400, 1), (1, 400, 1), (4, 0, 0), (5, 0, 0)]
    assert {r.key for r in rows} == {0, 1, 2, 3, 4} and all(r._first == "x" for r in rows)
    again = repeats.without_repeats(found.drop("key"))
    assert again.columns.count("kept") == 1


def test_empty_table(docs):
    assert removed(docs([(1, "x")]).where("doc_id > 1")) == []


def test_cut_characters_are_left_out_of_texts(docs):
    shared = "".join(random.Random(2).choice("abcdef") for _ in range(250))
    frame = docs([(1, "1" + shared + "é!"), (2, "2" + shared + "è?")])
    rows = {r.doc_id: r for r in repeats.without_repeats(frame, as_text=True).collect()}
    assert (rows[1].kept, rows[2].kept) == ("1!", "2?") and rows[1].n_removed == 251
    assert removed(frame)[0][4] == b"1\xa9!"


def test_maximal_repeats_name_all_occurrences():
    texts = ["xxabcdeyy", "zzabcdeyw", "qzabcdf"]
    at = 4  # the place of "c"
    rights, lefts = [t[at:].encode() for t in texts], [t[:at][::-1].encode() for t in texts]
    found = {(left, right, tuple(sorted(group))) for left, right, group in repeats.maximal_repeats(rights, lefts, 2)}
    assert found == {(2, 2, (0, 1, 2)), (2, 4, (0, 1)), (3, 2, (1, 2))}


def test_intervals_are_those_of_the_tree():
    shared = [1, 3, 3, 0, 2]
    assert sorted(repeats.intervals(shared, 1)) == [(1, 0, 3), (2, 4, 5), (3, 1, 3)]
