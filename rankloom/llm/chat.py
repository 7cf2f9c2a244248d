"""Chat formatting that survives a round trip through its own grammar.

    conversation := turn*
    turn         := "[INST] " text " [/INST]"               user
                  | " " text "</s>"                         assistant
                  | "<<SYS>>\\n" text "\\n<</SYS>>\\n\\n"   system
                  | "[ROLE:" role "] " text " [/ROLE]"      any other role, its "]" and "%" as %5D and %25

A turn is rendered as it is, the rendered run of turns is parsed again, and the
recovered turns are compared with the source. Turns from the first difference on
whose text holds a control string are escaped and the run is rendered anew,
until both are identical. Escaping puts a backslash behind the first character
of every control string, and one more where there are some already; parsing
takes one away from each, so escaped texts contain no control string and nothing
is lost.

Conversations may be of any length: rows are dealt by ranges of (conversation,
turn), so that a long conversation is formatted by many tasks, in consecutive
blocks. As each turn ends where its grammar says, parsing block after block
equals parsing the whole. A digest over a conversation's turns in order is
sequential by its nature; it is fed block by block and keeps no more than one.

Defined results: turns are ordered by turn, role, text, nulls first, and
repeated rows are turns of their own; a null text or role is empty; a null
conversation id is a conversation too. Other columns are left out. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

# The grammar's control strings.
CONTROLS = ["[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>", "[ROLE:", "[/ROLE]"]
FRAMES = {"user": ("[INST] ", " [/INST]"), "assistant": (" ", "</s>"), "system": ("<<SYS>>\n", "\n<</SYS>>\n\n")}
OTHER, OTHER_END = "[ROLE:", " [/ROLE]"

_tails = "|".join(re.escape(c[1:]) for c in CONTROLS)
_PLAIN = re.compile(rf"([\[<])(\\*)({_tails})")
_ESCAPED = re.compile(rf"([\[<])\\(\\*)({_tails})")

BLOCK_SCHEMA = pa.schema({
    "conv_id": pa.int64(), "block": pa.int64(), "n_turns": pa.int64(), "formatted": pa.string(),
    "loss_spans": pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()})),
})
DIGEST_SCHEMA = pa.schema({
    "conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(),
    "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64(),
})


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def render(turns: list[tuple[str, str]], escaped: list[bool]) -> tuple[str, list[tuple[int, int]]]:
    """The text of a run of turns and the spans of its assistant texts."""
    parts, spans, at = [], [], 0
    for (role, text), guard in zip(turns, escaped, strict=True):
        text = escape(text) if guard else text
        before, after = FRAMES.get(role) or (f"{OTHER}{role.replace('%', '%25').replace(']', '%5D')}] ", OTHER_END)
        if role == "assistant":
            spans.append((at + len(before), at + len(before) + len(text)))
        parts += before, text, after
        at += len(before) + len(text) + len(after)
    return "".join(parts), spans


def parse(formatted: str, partial: bool = False) -> list[tuple[str, str]]:
    """The turns of a rendered text, from left to right. ``partial``: up to the first that has no end."""
    turns, at = [], 0
    while at < len(formatted):
        for role, (before, after) in FRAMES.items():
            if role != "assistant" and formatted.startswith(before, at):
                break
        else:
            if formatted.startswith(OTHER, at):
                end = formatted.find("] ", at)
                role = formatted[at + len(OTHER) : end].replace("%5D", "]").replace("%25", "%")
                before, after = formatted[at : end + 2], OTHER_END
                if end < 0:
                    before = after = ""
            else:
                role, (before, after) = "assistant", FRAMES["assistant"]
        start = at + len(before)
        end = formatted.find(after, start) if after and formatted.startswith(before, at) else -1
        if end < 0:
            if partial:
                return turns
            raise ValueError(f"no turn at {at}")
        turns.append((role, unescape(formatted[start:end])))
        at = end + len(after)
    return turns


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """Rendered text and loss spans of a run of turns that parses back to them."""
    escaped = [False] * len(turns)
    while True:
        formatted, spans = render(turns, escaped)
        back = parse(formatted, partial=True)
        if back == turns:
            return formatted, spans
        same = next((i for i, (a, b) in enumerate(zip(back, turns, strict=False)) if a != b), min(len(back), len(turns)))
        # The first turn that differs is at fault, or one before it whose end came early or late.
        fault = [i for i in range(max(0, same - 1), len(turns)) if not escaped[i] and _PLAIN.search(turns[i][1])]
        if not fault:
            raise ValueError("a turn doesn't survive the round trip")
        for i in fault:
            escaped[i] = True


def format_conversations(rows: DataFrame, block_chars: int = 1_000_000) -> DataFrame:
    """Blocks of formatted conversations: conv_id, block, n_turns, formatted, loss_spans.

    The blocks of a conversation follow one another by ``block``; each holds turns
    of one conversation up to about ``block_chars`` characters.
    """
    clean = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    dealt = clean.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Tasks hold ascending ranges of turns, so their numbers order the blocks.
        conversation, turns, held, number = None, [], 0, TaskContext.get().partitionId() << 32

        def block() -> dict:
            nonlocal number
            number += 1
            formatted, spans = format_turns(turns)
            marked = [{"start": a, "end": b} for a, b in spans]
            return {"conv_id": conversation, "block": number, "n_turns": len(turns), "formatted": formatted, "loss_spans": marked}

        for batch in batches:
            done = []
            for conv, _, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if turns and (conv != conversation or held > block_chars):
                    done.append(block())
                    turns, held = [], 0
                conversation = conv
                turns.append((role, text))
                held += len(text)
            yield pa.RecordBatch.from_pylist(done, BLOCK_SCHEMA)
        if turns:
            yield pa.RecordBatch.from_pylist([block()], BLOCK_SCHEMA)

    return dealt.mapInArrow(run, from_arrow_schema(BLOCK_SCHEMA))


def digests(blocks: DataFrame) -> DataFrame:
    """Per conversation what its formatted blocks say: counts, and digests of all turns and of the loss texts.

    Blocks are read in order and only one is held at a time.
    """
    ordered = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conversation, state = None, None

        def result() -> dict:
            n_turns, turns, loss_chars, loss, chars = state
            values = conversation, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars
            return dict(zip(DIGEST_SCHEMA.names, values, strict=True))

        for batch in batches:
            done = []
            for conv, _, formatted, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state and conv != conversation:
                    done.append(result())
                    state = None
                conversation, state = conv, state or [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for span in spans:
                    text = unescape(formatted[span["start"] : span["end"]])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(formatted)
            yield pa.RecordBatch.from_pylist(done, DIGEST_SCHEMA)
        if state:
            yield pa.RecordBatch.from_pylist([result()], DIGEST_SCHEMA)

    return ordered.select("conv_id", "block", "formatted", "loss_spans").mapInArrow(run, from_arrow_schema(DIGEST_SCHEMA))
