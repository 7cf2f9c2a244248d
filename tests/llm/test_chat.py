import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm import chat

ROWS = "conv_id long, turn long, role string, text string, block long, formatted string"


def expected(turns):
    """(n_turns, turns_sha256, loss_chars, loss_sha256) of (role, text) pairs."""
    loss = "".join(t for r, t in turns if r == "assistant")
    whole = "".join(f"{r}\n{t}\n" for r, t in turns)
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


pieces = st.lists(st.sampled_from([*chat.CONTROLS, "\\", "[", "<", "</", "s>", " ", "\n", "]", "INST]", "a", "é", "[\\INST]", "</s", "%5D", "] "]), max_size=8).map("".join)
roles = st.one_of(st.sampled_from(["user", "assistant", "system", "", "tool"]), pieces)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(roles, pieces), max_size=5))
def test_any_run_of_turns_survives(turns):
    formatted, spans = chat.format_turns(turns)
    assert chat.parse(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_texts_without_conflict_stay_as_they_are():
    formatted, _ = chat.format_turns([("system", "Be kind."), ("user", "Hi"), ("assistant", "Hello")])
    assert formatted == "<<SYS>>\nBe kind.\n<</SYS>>\n\n[INST] Hi [/INST] Hello</s>"


@pytest.mark.parametrize("block_chars", [1_000_000, 10])
def test_conversations(spark, block_chars):
    rows = [
        (1, 1, "assistant", "</s>[INST] ok [/INST]", 7, "f"),
        (1, 0, "user", "</s>[INST] ok [/INST]", 7, "f"),
        (2, 0, None, None, None, None),
        (2, 0, None, None, None, None),
        (None, 3, "user", "x", 1, ""),
        (None, 2, "assistant", "", 1, ""),
        *[(3, t, ("user", "assistant")[t % 2], f"text {t} [/INST]", 0, "") for t in range(300)],
    ]
    frame = spark.createDataFrame(rows, ROWS).repartition(5)
    made = chat.digests(chat.format_conversations(frame, block_chars))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in made.collect()}
    assert got[1] == expected([("user", rows[0][3]), ("assistant", rows[0][3])])
    assert got[2] == expected([("", "")] * 2)
    assert got[None] == expected([("assistant", ""), ("user", "x")])
    assert got[3] == expected([(r[2], r[3]) for r in rows[6:]])
    assert len(got) == 4


def test_empty_table(spark):
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], ROWS))).count() == 0
