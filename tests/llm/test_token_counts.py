import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rankloom.llm import token_counts


@pytest.fixture(scope="module")
def counter():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return token_counts.Counter(file.read(), public_tokenizers.PATTERN)


TEXTS = ["", "a", "\n", "Hello world.\n\nNew line é日本\n", "a\n\n\n\nb", "日本語\nテキスト", "x" * 5000 + "\n" + "word " * 9000]


@pytest.mark.parametrize("text", TEXTS)
def test_spans_are_the_library_s_offsets(counter, text):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = library.encode(text, add_special_tokens=False)
    starts, ends = counter.spans(text)
    # The library leaves a leading blank out of a token's offsets.
    got = [(s + (text[s] == " " and e - s > 1), e) for s, e in zip(starts.tolist(), ends.tolist())]
    assert [e for _, e in got] == [e for _, e in want.offsets] and len(got) == len(want.ids)


def test_boundary_rule():
    bounds = np.array([0, 4, 8, 9, 20])
    spans = np.array([(0, 4), (3, 5), (3, 7), (7, 10), (6, 20), (8, 9), (2, 8)])
    own, crossing = token_counts.owners(spans[:, 0], spans[:, 1], bounds)
    assert own.tolist() == [0, 0, 1, 1, 3, 2, 1] and crossing.tolist() == [1, 2, 3, 4, 6]


def brute(counter, values):
    """n_tokens, n_crossing, field_tokens and section_tokens, from the owner of every single character."""
    text = values[-1] or ""
    owner = [f for f, v in enumerate(values[:-1]) for _ in range(len(v or "") + 1)]
    lines = text.split("\n")
    if len(lines) > 1 and not lines[-1]:
        lines.pop()  # a line break at the end belongs to its line
    for k, line in enumerate(lines):
        owner += [len(values) - 1 + k] * (len(line) + 1)
    whole = "\n".join(v or "" for v in values)
    owner = owner[: len(whole)]
    counts, crossing, tokens = [0] * (len(values) - 1 + len(lines)), 0, list(zip(*counter.spans(whole), strict=True))
    for start, end in tokens:
        held = owner[start:end]
        counts[max(sorted(set(held)), key=held.count)] += 1
        crossing += len(set(held)) > 1
    return len(tokens), crossing, [*counts[: len(values) - 1], sum(counts[len(values) - 1 :])], counts[len(values) - 1 :]


def messy(seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(["a", "word", " ", "\n", "\n\n", "  ", "é", "日本", "12", "!?", "\t", "\u2003"]) for _ in range(rng.randint(0, 60))) for _ in range(3)]


MANY = [["s", "en", t] for t in TEXTS] + [[None, None, None], ["", "", "a\nb"], ["x\ny", "é", "q"]] + [messy(s) for s in range(60)]


@pytest.mark.parametrize("values", MANY)
def test_counts_equal_brute_force(counter, values):
    assert token_counts.count(counter, values, True) == brute(counter, values)


def test_crossing_tokens_are_met(counter):
    assert any(token_counts.count(counter, v, True)[1] for v in MANY)


def test_cut_into_pieces_is_the_library_s(counter, monkeypatch):
    monkeypatch.setattr(token_counts, "LONG_BLANK", 1)
    for text in [t for v in MANY for t in v if t] + ["a  b\u2028\x1c\x85 c", "a" + " " * 300 + "b" + "\n" * 70, " \n \u3000 x  "]:
        assert counter.encode(text) == counter.encoding.encode_ordinary(text)


@pytest.mark.parametrize("run", [" ", "\n", "x", "\u2003", " \n", "é"])
def test_very_long_runs(counter, run):
    text = "a" + run * 5_000_000 + "b c"
    starts, ends = counter.spans(text)
    assert starts[0] == 0 and ends[-1] == len(text) and (starts[1:] <= ends[:-1]).all() and (starts[1:] >= starts[:-1]).all()


def test_attribute(spark, docs):
    frame = docs([(1, "a\nb"), (1, "a\nb"), (None, None), (4, ""), (5, "long " * 30_000), (6, "a" + " " * 1_000_000 + "b")]).withColumnRenamed("key", "n_tokens")
    ranks = token_counts.share_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    made = token_counts.attribute(frame, ranks, public_tokenizers.PATTERN, ["source", "lang", "text"])
    assert made.columns == [*(c for c in frame.columns if c != "n_tokens"), "n_tokens", "n_crossing", "field_tokens", "section_tokens"]
    rows = made.collect()
    assert [len(r.section_tokens) for r in rows] == [2, 2, 1, 1, 1, 1] and all(r.n_tokens == sum(r.field_tokens) for r in rows)
    assert token_counts.attribute(frame.where("false"), ranks, public_tokenizers.PATTERN, ["text"], False).count() == 0
