import pickle
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rankloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def pair():
    with open(PATH, encoding="utf-8") as file:
        return bpe.Codec(file.read(), remembered=30_000), Tokenizer.from_file(PATH)


def cases():
    rng = random.Random(1)
    letters = "ab c\n'sd1é!<|　\t \xa0zst "
    yield from ["", " ", "  ", "a  b", "a \n b", "a\n \nb", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "a" * 3000, "ab" * 999, "don't you're I'll", "\x1c x\x85y", "word. " * 3000]
    for _ in range(1500):
        yield "".join(rng.choice(letters) for _ in range(rng.randint(1, 40)))
    for _ in range(800):
        yield "".join(chr(rng.choice([rng.randint(1, 0x7F), rng.randint(0x80, 0x2FFF), rng.randint(0x3000, 0xD7FF)])) for _ in range(rng.randint(1, 40)))


def test_equals_the_library(pair):
    codec, library = pair
    for text in cases():
        ids = np.frombuffer(codec.encode(text), np.int32).tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids, text
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_memory_is_bounded(pair):
    codec, _ = pair
    entries = codec.words | codec.earlier
    assert entries and sum(bpe.ENTRY_BYTES + len(k) + len(v) for k, v in entries.items()) <= 30_000
    assert max(map(len, entries)) <= bpe.LONG_WORD and len(codec.pairs.asked) == 1 << bpe.TABLE_BITS


def test_texts_together_are_as_each_alone(pair):
    codec, library = pair
    texts = [*cases()][::3] + ["x" * 500 + " " + "中" * 400, "base64" * 3000, "a" * 199, "a" * 200, "a" * 201]
    for text, ids in zip(texts, codec.encode_all(texts), strict=True):
        assert np.frombuffer(ids, np.int32).tolist() == library.encode(text, add_special_tokens=False).ids


def stays(pairs, first, second):
    """The test on one pair, by its definition."""
    rank = dict(zip(pairs.keys[:-1].tolist(), pairs.ranks[:-1].tolist(), strict=True))

    def edge(token, below):
        gone = bpe.NEVER
        while token >= 0:
            yield token, gone
            token, gone = int(below[token]), int(pairs.gone[token])

    for a, a_gone in edge(first, pairs.right):
        for b, b_gone in edge(second, pairs.left):
            if (r := rank.get(a << 32 | b, bpe.NEVER)) < a_gone and r < bpe.NEVER and r <= b_gone:
                return False
    return True


def test_pairs_on_arrays_are_as_one_by_one(pair, monkeypatch):
    codec, _ = pair
    rng = np.random.default_rng(2)
    first, second = rng.integers(0, 50_000, (2, 300))
    want = [stays(codec.pairs, int(a), int(b)) for a, b in zip(first, second, strict=True)]
    first, second, want = np.tile(first, 9), np.tile(second, 9), want * 9
    small = bpe.Pairs(np.empty((0, 3), np.int64), 1)
    vars(small).update(vars(codec.pairs))
    monkeypatch.setattr(bpe, "TABLE_BITS", 6)  # most answers are displaced
    small.asked, small.answers = np.full(64, -1, np.int64), np.zeros(64, bool)
    for _ in range(3):
        assert small.apart(first, second).tolist() == want
    monkeypatch.undo()
    assert codec.pairs.apart(first, second).tolist() == want


def test_sent_codecs_are_the_same_and_remember_nothing(pair):
    codec, _ = pair
    sent = pickle.dumps(codec)
    again = pickle.loads(sent)
    texts = [*cases()][:300]
    assert len(sent) < 12 << 20 and not again.words and again.encode_all(texts) == codec.encode_all(texts)


def test_ids_that_cut_characters_decode_as_in_the_library(pair):
    codec, library = pair
    rng = random.Random(4)
    for _ in range(300):
        ids = [rng.choice([rng.randint(0, 255), rng.randint(0, 50256)]) for _ in range(6)]
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)
    lists = [[], None, [50256, 0], [rng.randint(0, 255) for _ in range(9)], [1, 2, 3]]
    for part in (lists, lists[2:], [[262, 640]], []):
        got = codec.decode_all(pa.array([[7], *part], pa.list_(pa.int32())).slice(1)).to_pylist()
        assert got == [codec.decode(x or []) for x in part]


def test_frames(spark, docs):
    frame = docs([(1, "a <|endoftext|> é"), (1, "a <|endoftext|> é"), (None, None), (4, ""), (5, "wörter " * 30_000)]).withColumnRenamed("key", "ids").withColumnRenamed("_first", "decoded")
    vocabulary = bpe.share_vocabulary(spark, PATH)
    both = bpe.decode(bpe.encode(frame, vocabulary), vocabulary)
    assert both.columns == [*(c for c in frame.columns if c not in ("ids", "decoded")), "ids", "decoded"]
    for r in both.collect():
        assert r.decoded == (r.text or "") and len(r.ids or []) > 0 or not r.text
    fused = bpe.round_trip(frame, vocabulary)
    assert fused.columns == [c for c in both.columns if c != "text"]
    assert sorted(map(repr, fused.collect())) == sorted(map(repr, both.drop("text").collect()))
    listed = bpe.round_trip(frame.withColumn("n_tokens", F.lit("x")), vocabulary, as_text=True).collect()
    assert sorted((r.ids, r.n_tokens) for r in listed) == sorted((",".join(map(str, r.ids)), len(r.ids)) for r in fused.collect())
    assert bpe.decode(bpe.encode(frame.where("false"), vocabulary), vocabulary).count() == 0
