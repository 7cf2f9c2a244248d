"""Periodic runs of words, by recompression.

A run is a stretch of words with smallest period q, of at least ``least`` words
and ``times`` periods, that no neighbouring word extends.

Candidates come from a harmonic grid. A run with period p holds a window of
max(least, times * p) - p places whose words return p places later. Grid points
half a window apart meet every such window at least twice in a row, so places
where two grid points running have equal words p further on are all there is to
look at; the grids of all periods together have about n log n points.

How far a candidate extends is answered by a grammar. Recompression turns the
words into ever shorter sequences, in turns by blocks (a symbol and its
repetitions become one symbol) and by pairs (symbols are dealt into left and
right ones, and a left one before a right one becomes one symbol with it).
Equal stretches get equal symbols but for a few at their edges. A query for the
longest common extension of two places climbs as long as both are edges of a
symbol, then comes down to the first difference, with a few steps a level. No
symbol spans two texts, and the levels end when none occurs twice. Texts without
a candidate have no runs and get no grammar.

Texts are taken by some 500,000 words at a time; one longer text is a group of
its own, of about a hundred bytes a word for the grammar, and its candidates are
extended by blocks of a million.

Defined results: a null, empty or blank text has no words, no runs and an empty
collapsed text. Repeated rows have equal results; rows never meet. Runs are
ordered by start, then period; among runs of equal exponent the best is that
with the smallest start, then period. Other columns are passed on, but for those
of the names of the results. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm.batches import short

GROUP_WORDS, CANDIDATES = 500_000, 1_000_000
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)


def _named(codes: np.ndarray) -> tuple[np.ndarray, int]:
    """Equal codes as equal numbers from 0 on, and how many there are."""
    known, names = np.unique(codes, return_inverse=True)
    return names.astype(np.int64), len(known)


def _right(names: int, level: int) -> np.ndarray:
    """For every symbol of a level, whether it is a right one: a fixed bit of a hash."""
    x = (np.arange(names, dtype=np.uint64) + np.uint64(level * 0x10001 + 1)) * np.uint64(_MIX[0])
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_MIX[1])
    return (x >> np.uint64(40) & np.uint64(1)).astype(bool)


class Grammar:
    """The levels of a sequence under recompression, with an end mark on either side."""

    def __init__(self, sequence: np.ndarray):
        symbols, count = _named(np.asarray(sequence, np.int64))
        symbols = np.concatenate([[count], symbols, [count + 1]])
        count += 2
        self.levels, self.first, self.parent, self.is_block = [symbols.astype(np.int32)], [], [], []
        rounds = 0
        while count < len(symbols):
            opens = np.concatenate([[True], symbols[1:] != symbols[:-1]])
            if not opens.all():
                starts = np.flatnonzero(opens)
                sizes = np.diff(np.append(starts, len(symbols)))
                symbols, count = self._level(symbols[starts] * (int(sizes.max()) + 1) + sizes, opens, True)
            else:
                right = _right(count, rounds)[symbols]
                rounds += 1
                joins = ~right[:-1] & right[1:]
                if not joins.any():
                    continue
                opens = np.concatenate([[True], ~joins])
                starts = np.flatnonzero(opens)
                second = np.where(np.append(joins, False)[starts], np.append(symbols, 0)[starts + 1] + 1, 0)
                symbols, count = self._level(symbols[starts] * (count + 1) + second, opens, False)

    def _level(self, codes: np.ndarray, opens: np.ndarray, is_block: bool) -> tuple[np.ndarray, int]:
        symbols, count = _named(codes)
        self.levels.append(symbols.astype(np.int32))
        self.first.append(np.append(np.flatnonzero(opens), len(opens)).astype(np.int32))
        self.parent.append((np.cumsum(opens) - 1).astype(np.int32))
        self.is_block.append(is_block)
        return symbols, count

    def _left_over(self, level: int, at: np.ndarray, ahead: bool) -> np.ndarray:
        """Symbols from a place of a level to the end of its parent, that place included."""
        parent, first = self.parent[level][at], self.first[level]
        return first[parent + 1] - at if ahead else at - first[parent] + 1

    def _match(self, level: int, x: np.ndarray, y: np.ndarray, ahead: bool, climb: bool) -> np.ndarray:
        """Moves the places on over equal symbols; True where both came to the edge of parents (only if ``climb``)."""
        symbols, sign = self.levels[level], 1 if ahead else -1
        top = level == len(self.parent)
        up, open_ = np.zeros(len(x), bool), np.arange(len(x))
        while len(open_):
            a, b = x[open_], y[open_]
            if climb and not top:
                parents = self.parent[level][a], self.parent[level][b]
                first = self.first[level]
                if ahead:
                    edge = (first[parents[0]] == a) & (first[parents[1]] == b)
                else:
                    edge = (first[parents[0] + 1] - 1 == a) & (first[parents[1] + 1] - 1 == b)
                up[open_[edge]] = True
            else:
                edge = np.zeros(len(a), bool)
            on = ~edge & (symbols[a] == symbols[b])
            open_, a, b = open_[on], a[on], b[on]
            if not len(open_):
                break
            step = 1
            if not top and self.is_block[level]:
                step = np.minimum(self._left_over(level, a, ahead), self._left_over(level, b, ahead))
            x[open_] += sign * step
            y[open_] += sign * step
        return up

    def common(self, i: np.ndarray, j: np.ndarray, ahead: bool = True) -> np.ndarray:
        """Lengths of the longest common stretches that begin (or, not ``ahead``, end) at places i and j, i <> j."""
        x, y = i.astype(np.int64) + 1, j.astype(np.int64) + 1
        ended, open_ = np.zeros(len(x), np.int64), np.arange(len(x))
        for level in range(len(self.levels)):
            a, b = x[open_], y[open_]
            up = self._match(level, a, b, ahead, True)
            if level < len(self.parent):
                a[up], b[up] = self.parent[level][a[up]], self.parent[level][b[up]]
            x[open_], y[open_] = a, b
            ended[open_] = level
            open_ = open_[up]
            if not len(open_):
                break
        for level in range(int(ended.max(initial=0)), 0, -1):
            down = np.flatnonzero(ended >= level)
            first = self.first[level - 1]
            a, b = (first[z[down]] if ahead else first[z[down] + 1] - 1 for z in (x, y))
            a, b = a.astype(np.int64), b.astype(np.int64)
            self._match(level - 1, a, b, ahead, False)
            x[down], y[down] = a, b
        return x - 1 - i if ahead else i - (x - 1)


def grid_hits(words: np.ndarray, sizes: np.ndarray, least: int, times: int) -> Iterator[tuple[int, np.ndarray]]:
    """(period, places) where a run may be; texts lie one after the other, the longest first."""
    ends = np.cumsum(sizes)
    for period in range(1, int(sizes[0]) // times + 1):
        shortest = max(least, times * period)
        texts = int(np.searchsorted(-sizes, -shortest, "right"))
        if not texts:
            return
        window, upto = shortest - period, int(ends[texts - 1])
        step = max(1, window // 2)
        same = words[: upto - period : step] == words[period:upto:step]
        if 2 * step <= window:
            same = same[:-1] & same[1:]
        hits = np.flatnonzero(same)
        if len(hits):
            yield period, hits * step


def runs_of(words: list[np.ndarray], least: int = 24, times: int = 3) -> list[np.ndarray]:
    """The runs of texts given as word numbers, each as rows of (start, length, period)."""
    if least < 1 or times < 2:
        raise ValueError("runs have at least two periods")
    sizes = np.array([len(w) for w in words], np.int64)
    out = [np.empty((0, 3), np.int64) for _ in words]
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] >= max(least, times)]
    if not len(order):
        return out
    # Numbers of different texts differ, so nothing matches across texts.
    tops = np.cumsum([0, *(int(words[k].max()) + 1 for k in order)])
    joined = np.concatenate([words[k] + top for k, top in zip(order, tops, strict=False)])
    sizes = sizes[order]
    begins = np.cumsum(sizes) - sizes
    found = list(grid_hits(joined, sizes, least, times))
    if not found:
        return out
    text = [np.searchsorted(begins, places, "right") - 1 for _, places in found]
    with_hits = np.unique(np.concatenate(text))
    moved = np.zeros(len(sizes), np.int64)
    moved[with_hits] = np.cumsum(sizes[with_hits]) - sizes[with_hits] - begins[with_hits]
    grammar = Grammar(np.concatenate([joined[begins[k] : begins[k] + sizes[k]] for k in with_hits]))
    at = np.concatenate([places + moved[t] for (_, places), t in zip(found, text, strict=True)])
    period = np.concatenate([np.full(len(places), p) for p, places in found])
    kept = np.empty((0, 3), np.int64)
    for k in range(0, len(at), CANDIDATES):
        i, p = at[k : k + CANDIDATES], period[k : k + CANDIDATES]
        inside = i + p < len(grammar.levels[0]) - 2  # the grid may reach into a text that was left out
        i, p = i[inside], p[inside]
        start, end = i - grammar.common(i - 1, i + p - 1, False), i + p + grammar.common(i, i + p)
        long = (end - start >= np.maximum(least, times * p)) & (end - start >= 2 * p)
        # Of one stretch the smallest period counts: rows are in order of stretch, then period.
        kept = np.unique(np.concatenate([kept, np.column_stack([start, end, p])[long]]), axis=0)
        kept = kept[np.concatenate([[True], (kept[1:, :2] != kept[:-1, :2]).any(axis=1)])] if len(kept) else kept
    kept = kept[np.lexsort((kept[:, 2], kept[:, 0]))]
    new_begins = begins[with_hits] + moved[with_hits]
    owner = np.searchsorted(new_begins, kept[:, 0], "right") - 1
    for k, place in enumerate(with_hits):
        own = kept[owner == k] if len(kept) else kept
        out[order[place]] = np.column_stack([own[:, 0] - new_begins[k], own[:, 1] - own[:, 0], own[:, 2]])
    return out


def best_of(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run of the greatest exact length / period, then of the smallest start, then period."""
    return min(map(tuple, runs.tolist()), key=lambda r: (Fraction(-r[1], r[2]), r[0], r[2]), default=None)


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by a blank, without those that lie in a run after its first period."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs.tolist():
        keep[start + period : start + length] = False
    return b" ".join(words if keep.all() else [words[k] for k in np.flatnonzero(keep).tolist()])


def numbered(words: list[bytes]) -> np.ndarray:
    known = {w: k for k, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


_RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
RESULT = [("n_words", T.LongType()), ("runs", T.ArrayType(_RUN)), ("best", _RUN), ("collapsed", T.StringType())]
_ARROW_RUN = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])


def find_runs(docs: DataFrame, text: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """``docs`` without the text column and with n_words, its runs, the best of them and the collapsed text."""
    kept = [f for f in docs.schema if f.name not in (*(n for n, _ in RESULT), text)]
    schema = T.StructType([*kept, *(T.StructField(n, t) for n, t in RESULT)])

    def group(passed: pa.Array, words: list[list[bytes]]) -> pa.RecordBatch:
        runs = runs_of([numbered(w) for w in words], least, times)
        rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in x.tolist()] for x in runs]
        best = [b and dict(zip(("start", "length", "period"), b, strict=True)) for b in map(best_of, runs)]
        made = [
            pa.array([len(w) for w in words], pa.int64()),
            pa.array(rows, pa.list_(_ARROW_RUN)),
            pa.array(best, _ARROW_RUN),
            pa.array([collapsed(w, r) for w, r in zip(words, runs, strict=True)], pa.binary()).cast(pa.string()),
        ]
        return pa.RecordBatch.from_arrays([*passed.flatten(), *made], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches, 1024):
            held, begin, size = [], 0, 0
            for row in range(batch.num_rows):
                # Splitting bytes cuts at blanks and at the five controls from tab on, and nowhere else.
                held.append((batch.column(1)[row].as_py() or "").encode().split())
                size += len(held[-1])
                if size >= GROUP_WORDS:
                    yield group(batch.column(0).slice(begin, len(held)), held)
                    held, begin, size = [], row + 1, 0
            if held:
                yield group(batch.column(0).slice(begin, len(held)), held)

    passed = F.struct(*(F.col(f"`{f.name}`") for f in kept)).alias("passed")
    return docs.select(passed, F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)
