"""Fill-in-the-middle texts, cut where repeated captures of one match end.

A text is matched as a whole by ``(unit)*``, and the regular-expression library
keeps every repetition of the group. The ends of its captures therefore give the
number of units and both cut offsets at once; no loop goes over the units. Texts
of more than ``BLOCK`` characters are matched in stretches of that many units,
one after the other, so the captures held at a time are bounded.

Hashes of the document's id choose the cuts and the form: prefix, suffix and
middle behind a marker each (``psm``), suffix first (``spm``), or the text as it
is (``plain``). ``restore`` rebuilds the text from output and form: no text with
a marker in it is cut, and markers must not overlap each other, so the first
marker found is always the one that was put there.

Defined results: a null text counts as empty; an empty text, one that holds a
marker and one that the units don't cover are plain (the last with null units).
A null id is hashed as an empty string. Rows never meet, so repeated rows have
equal results and ties need no rule. Other columns are passed on, but for those
of the names of the results, which are replaced. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm.batches import short

MARKERS = ("<P>", "<S>", "<M>")
CODE_POINT = "."
BLOCK = 1 << 16
RESULT = [("units", "long"), ("form", "string"), ("prefix_chars", "long"), ("middle_chars", "long"), ("output", "string")]


class Units:
    """Where the units of a text end."""

    def __init__(self, unit: str = CODE_POINT):
        self.all = regex.compile(f"({unit})*+", regex.DOTALL)
        self.stretch = regex.compile(f"({unit}){{1,{BLOCK}}}+", regex.DOTALL)

    def ends(self, text: str) -> np.ndarray | None:
        """The end offset of every unit; None if the units don't cover the text."""
        if len(text) <= BLOCK:
            match = self.all.fullmatch(text)
            return match and np.array(match.ends(1), np.int64)
        found, at = [], 0
        while at < len(text):
            match = self.stretch.match(text, at)
            if match is None or match.end() == at:
                return None
            found.append(np.array(match.ends(1), np.int64))
            at = match.end()
        return np.concatenate(found)


def check_markers(markers: tuple[str, str, str]) -> None:
    """Refuses markers that could be found across the place where one was put."""
    for a in markers:
        for b in markers:
            overlap = any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (a != b)) if k < len(a) or a != b)
            if not a or (a != b and a in b) or overlap:
                raise ValueError(f"markers {a!r} and {b!r} overlap")
    if len(set(markers)) < 3:
        raise ValueError("three different markers are needed")


def draws(doc_id: int | None, salt: str = "1:") -> tuple[int, int, int, int]:
    """Four numbers of 32 bits from the hash of an id."""
    digest = sha256(f"{salt}{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4))


def cut(text: str, units: Units, numbers: tuple[int, int, int, int], markers=MARKERS, plain_from: int = 90, spm_below: int = 20):
    """(units, form, prefix_chars, middle_chars, output) of one text."""
    ends = units.ends(text)
    if ends is None:
        return None, "plain", None, None, text
    n, (h1, h2, h3, h4) = len(ends), numbers
    if not text or h3 % 100 >= plain_from or any(m in text for m in markers):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    low, high = (int(ends[k - 1]) if k else 0 for k in (low, high))
    p, s, m = markers
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if h4 % 100 < spm_below:
        return n, "spm", low, high - low, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", low, high - low, f"{p}{prefix}{s}{suffix}{m}{middle}"


def transform(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", unit: str = CODE_POINT, markers=MARKERS, plain_from: int = 90, spm_below: int = 20, salt: str = "1:"
) -> DataFrame:
    """``docs`` without the text column and with units, form, prefix_chars, middle_chars and output.

    Of a hundred documents some ``plain_from`` are cut, and ``spm_below`` in a
    hundred of these have the suffix first.
    """
    check_markers(markers)
    names = [n for n, _ in RESULT]
    kept = [f for f in docs.schema if f.name not in (*names, text)]
    schema = T.StructType([*kept, *(T.StructField(n, T.LongType() if t == "long" else T.StringType()) for n, t in RESULT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(unit)
        for batch in short(batches):
            ids, texts = (batch.column(k).to_pylist() for k in (1, 2))
            rows = [cut(t or "", units, draws(i, salt), markers, plain_from, spm_below) for i, t in zip(ids, texts, strict=True)]
            made = [pa.array(c, pa.int64() if t == "long" else pa.string()) for c, (_, t) in zip(zip(*rows, strict=True), RESULT, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.column(0).flatten(), *made], schema.names)

    passed = F.struct(*(F.col(f"`{f.name}`") for f in kept)).alias("passed")
    return docs.select(passed, F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)


def restored(output: str | Column = "output", form: str | Column = "form", markers=MARKERS) -> Column:
    """The text that an output of this form was made of, exactly."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, "|".join(regex.escape(m) for m in markers), -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
