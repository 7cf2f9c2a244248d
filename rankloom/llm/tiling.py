"""Benchmark decontamination by greedy string tiling.

Texts are read as lower-cased words. A document and a benchmark item that share
a seed, that is ``min_words`` words in a row, are tiled: the longest matches of
words not yet marked are marked again and again, until none of ``min_words`` is
left. Matches are found by running Karp-Rabin: the hashes of all unmarked
windows of a search length are looked up, hits are checked word by word and
extended, and the search length falls from long to short. As tiles may lie in
any order, a passage whose sentences were moved is covered like the original.
The share of the item's words in tiles is its coverage.

The benchmark is a stated query set: it is cut into blocks of at most
``block_bytes`` of text, and each block is sent to the tasks, which pass their
documents by it once. Nothing of the documents is shuffled.

Defined results: null and empty texts match nothing, nor do items of fewer than
``min_words`` words. Repeated documents and items give repeated results; of
equally long matches the first in the item, then in the document, is marked.
Other columns are passed on where documents are filtered.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.batches import short

_WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)

MATCHES = "doc_id long, item_id long, item_words int, covered_words int, tiles array<struct<item_at:int,doc_at:int,words:int>>"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def window_hashes(tokens: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``width`` words, mod 2^64, by doubling."""
    if len(tokens) < width:
        return np.empty(0, np.uint64)
    values = (tokens.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(29)
    out, done, power, step, factor = np.zeros(len(tokens), np.uint64), 0, values, 1, np.array([_BASE])
    # ``power`` hashes ``step`` words; windows are put together from the powers of two in ``width``.
    rest = width
    while rest:
        if rest & 1:
            out = out[: len(tokens) - done - step + 1] * factor + power[done : len(tokens) - step + 1]
            done += step
        rest >>= 1
        if rest:
            power = power[: len(power) - step] * factor + power[step:]
            factor, step = factor * factor, step * 2
    return out


def _free_runs(marked: np.ndarray) -> np.ndarray:
    """How many unmarked words follow at each place, itself included."""
    end = np.where(marked, np.arange(len(marked)), len(marked))
    return np.minimum.accumulate(end[::-1])[::-1] - np.arange(len(marked))


def _matches(item, doc, item_marked, doc_marked, width):
    """(words, item_at, doc_at) of all longest unmarked matches of at least ``width`` words."""
    item_free, doc_free = _free_runs(item_marked), _free_runs(doc_marked)
    ours, theirs = window_hashes(item, width), window_hashes(doc, width)
    open_item, open_doc = np.flatnonzero(item_free[: len(ours)] >= width), np.flatnonzero(doc_free[: len(theirs)] >= width)
    places = defaultdict(list)
    for at, value in zip(open_doc.tolist(), theirs[open_doc].tolist(), strict=True):
        places[value].append(at)
    found = []
    for at in open_item.tolist():
        for there in places.get(int(ours[at]), ()):
            before = at and there and not item_marked[at - 1] and not doc_marked[there - 1] and item[at - 1] == doc[there - 1]
            if before and at - 1 + width <= len(item):
                continue  # inside a match that begins earlier
            reach = min(item_free[at], doc_free[there])
            same = item[at : at + reach] == doc[there : there + reach]
            length = int(reach if same.all() else same.argmin())
            if length >= width:
                found.append((length, at, there))
    return found


def tile(item: np.ndarray, doc: np.ndarray, min_words: int, first_width: int = 32) -> list[tuple[int, int, int]]:
    """(item_at, doc_at, words) of the tiles, longest first."""
    item_marked, doc_marked, tiles = np.zeros(len(item), bool), np.zeros(len(doc), bool), []
    width = max(min_words, min(first_width, len(item)))
    while True:
        found = _matches(item, doc, item_marked, doc_marked, width)
        longest = max((f[0] for f in found), default=0)
        if longest > 2 * width:
            width = longest
            continue
        queue = [(-length, at, there) for length, at, there in found]
        heapq.heapify(queue)
        while queue:
            length, at, there = heapq.heappop(queue)
            length = -length
            taken = item_marked[at : at + length] | doc_marked[there : there + length]
            if not taken.any():
                item_marked[at : at + length] = doc_marked[there : there + length] = True
                tiles.append((at, there, length))
                continue
            # What is left of it between the marks is a shorter match.
            edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
            for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if end - begin >= width:
                    heapq.heappush(queue, (begin - end, at + begin, there + begin))
        if width == min_words:
            return tiles
        width = max(min_words, width // 2)


class Items:
    """A block of benchmark items, indexed by the hashes of their seeds."""

    def __init__(self, items: list[tuple[int | None, str | None]], min_words: int):
        self.min_words, self.number, self.items = min_words, {}, []
        seeds = defaultdict(set)
        for item_id, text in items:
            words = words_of(text)
            if len(words) < min_words:
                continue
            tokens = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words])
            for value in window_hashes(tokens, min_words).tolist():
                seeds[value].add(len(self.items))
            self.items.append((item_id, tokens))
        self.seeds = {k: sorted(v) for k, v in seeds.items()}
        self.known = np.sort(np.array(list(seeds), np.uint64))

    def matches(self, text: str | None) -> Iterator[tuple[int | None, int, list[tuple[int, int, int]]]]:
        """(item_id, its words, tiles) of every item that shares a seed with the text."""
        number = self.number
        tokens = np.array([number.get(w, 0) for w in words_of(text)], np.int64)
        if len(tokens) < self.min_words or not len(self.known):
            return
        # Seeds hold only words of the items.
        unknown = np.concatenate([[0], np.cumsum(tokens == 0)])
        able = np.flatnonzero(unknown[self.min_words :] == unknown[: -self.min_words])
        if not len(able):
            return
        values = window_hashes(tokens, self.min_words)[able]
        place = np.minimum(np.searchsorted(self.known, values), len(self.known) - 1)
        hits = np.unique(values[self.known[place] == values]).tolist()
        for k in sorted(set().union(*(self.seeds[v] for v in hits))):
            item_id, item = self.items[k]
            tiles = tile(item, tokens, self.min_words)
            if tiles:
                yield item_id, len(item), tiles


def blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list]:
    """The benchmark's rows in blocks of about ``block_bytes`` of text, one after the other on the driver.

    Rows are dealt to blocks by hash, so a block's size is measured, not hoped for.
    """
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    number = -(-total // block_bytes) or 1
    share = F.pmod(F.xxhash64("item_id", "text"), F.lit(number))
    for k in range(number):
        rows = benchmark.where(share == k) if number > 1 else benchmark
        yield [(r.item_id, r.text) for r in rows.select(F.col("item_id").cast("long"), "text").collect()]


def matches(docs: DataFrame, benchmark: DataFrame, min_coverage: float = 0.5, min_words: int = 5, block_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, item_id, item_words, covered_words, tiles) of all pairs with at least ``min_coverage``."""
    spark, result = docs.sparkSession, None
    for block in blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items(shared.value, min_words)
            for batch in short(batches):
                made = defaultdict(list)
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for item_id, size, tiles in items.matches(text):
                        covered = sum(t[2] for t in tiles)
                        if covered >= min_coverage * size:
                            for name, value in zip(("doc_id", "item_id", "item_words", "covered_words"), (doc_id, item_id, size, covered), strict=True):
                                made[name].append(value)
                            made["tiles"].append([dict(zip(("item_at", "doc_at", "words"), t, strict=True)) for t in tiles])
                if made:
                    yield pa.RecordBatch.from_pydict(made, _MATCH_SCHEMA)

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, MATCHES)
        result = part if result is None else result.unionAll(part)
    return result


_MATCH_SCHEMA = pa.schema({
    "doc_id": pa.int64(), "item_id": pa.int64(), "item_words": pa.int32(), "covered_words": pa.int32(),
    "tiles": pa.list_(pa.struct({"item_at": pa.int32(), "doc_at": pa.int32(), "words": pa.int32()})),
})


def clean(docs: DataFrame, benchmark: DataFrame, min_coverage: float = 0.5, min_words: int = 5, block_bytes: int = 16 << 20) -> DataFrame:
    """The documents that cover no item of the benchmark to ``min_coverage``."""
    for block in blocks(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items(shared.value, min_words)
            for batch in short(batches):
                kept = [
                    not any(sum(t[2] for t in tiles) >= min_coverage * size for _, size, tiles in items.matches(text))
                    for text in batch.column("text").to_pylist()
                ]
                yield batch.filter(pa.array(kept, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
