"""Token counts of a document's fields and sections, from one encoding of the whole.

A document is its fields one after the other, each but the last followed by a
line break; the last field is cut into sections after every line break, or not
at all. Every field and section is thus a span of characters, and the spans
cover the document. It is encoded once as a whole; each token has a span of
characters too (that of all characters of which it holds a byte), and the two
sets of spans are joined. A token inside one span counts there. One that crosses
a boundary counts for the span that holds most of its characters, the earlier
one of equals, so the counts add up to the document's.

Defined results: a null field is empty and has no tokens of its own, only those
of its line break; an empty document has one empty section. Rows never meet, so
repeated rows and ties between them need no rule. Other columns are passed on,
but for those of the names of the results, which are replaced. The library's
matcher keeps a state for every character of a run of white space and overflows
on some hundred thousand of them; texts with such a run are cut into the pattern's
pieces by another matcher, and every piece is encoded for itself, as the library
does after its own cut.
"""

from __future__ import annotations

from base64 import b64decode
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rankloom.llm.batches import short

# White space in a row that is left to the library's matcher.
LONG_BLANK = 50_000
_BLANKS = regex.compile(r"\s+")

RESULTS = {
    "n_tokens": T.LongType(),
    "n_crossing": T.LongType(),
    "field_tokens": T.ArrayType(T.IntegerType()),
    "section_tokens": T.ArrayType(T.IntegerType()),
}


def share_ranks(spark, path: str):
    """The rank file's bytes, read once on the driver and sent to the workers (1 MB)."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


class Counter:
    def __init__(self, ranks: bytes, pattern: str):
        table = {b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.length = np.zeros(max(table.values()) + 1, np.int64)
        self.length[list(table.values())] = list(map(len, table))
        self.pattern = regex.compile(pattern)

    def encode(self, text: str) -> list[int]:
        if len(text) <= LONG_BLANK or max(map(len, _BLANKS.findall(text)), default=0) <= LONG_BLANK:
            return self.encoding.encode_ordinary(text)
        return [i for piece in self.pattern.finditer(text) for i in self.encoding._encode_single_piece(piece.group())]

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First character and end of every token."""
        sizes = self.length[np.array(self.encode(text), np.int64)]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        data = np.frombuffer(text.encode(), np.uint8)
        if len(data) == len(text):
            return starts, ends
        character = np.cumsum((data & 0xC0) != 0x80) - 1
        return character[starts], character[ends - 1] + 1


def owners(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The span that each token counts for, and which tokens cross a boundary.

    Span i holds the characters from ``bounds[i]`` to ``bounds[i + 1]``.
    """
    own = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends - 1, "right") - 1
    crossing = np.flatnonzero(own != last)
    for i in crossing:
        met = np.arange(own[i], last[i] + 1)
        held = np.minimum(ends[i], bounds[met + 1]) - np.maximum(starts[i], bounds[met])
        own[i] = met[held.argmax()]
    return own, crossing


def section_bounds(text: str, start: int) -> list[int]:
    """Where the sections of a text that begins at ``start`` begin: after every line break that isn't its last character."""
    found, at = [start], text.find("\n")
    while 0 <= at < len(text) - 1:
        found.append(start + at + 1)
        at = text.find("\n", at + 1)
    return found


def count(counter: Counter, values: list[str | None], sections: bool) -> tuple[int, int, list[int], list[int]]:
    """n_tokens, n_crossing, field_tokens and section_tokens of one document."""
    filled = [v or "" for v in values]
    document = "\n".join(filled)
    fields = np.concatenate([[0], np.cumsum([len(v) + 1 for v in filled])])[: len(filled)]
    bounds = np.array([*fields[:-1], *(section_bounds(filled[-1], int(fields[-1])) if sections else fields[-1:]), len(document)], np.int64)
    own, crossing = owners(*counter.spans(document), bounds)
    per_span = np.bincount(own, minlength=len(bounds) - 1)
    first = len(filled) - 1
    return len(own), len(crossing), [*per_span[:first].tolist(), int(per_span[first:].sum())], per_span[first:].tolist()


_COUNTERS: dict[int, Counter] = {}


def attribute(docs: DataFrame, ranks, pattern: str, fields: list[str], sections: bool = True) -> DataFrame:
    """``docs`` with n_tokens, n_crossing, field_tokens (by ``fields``) and section_tokens (of the last field)."""
    kept = [f for f in docs.schema if f.name not in RESULTS]
    schema = T.StructType([*kept, *(T.StructField(n, t) for n, t in RESULTS.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash((ranks.value, pattern))
        counter = _COUNTERS.get(key) or _COUNTERS.setdefault(key, Counter(ranks.value, pattern))
        types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        for batch in short(batches):
            rows = [count(counter, list(v), sections) for v in zip(*(batch.column(f).to_pylist() for f in fields), strict=True)]
            made = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *made], schema.names)

    return docs.mapInArrow(run, schema)
