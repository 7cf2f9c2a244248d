"""Repeated passages by a sparse enhanced suffix array and its interval tree.

A passage repeats if its ``length`` bytes also start anywhere else. Suffixes are
sampled so that every passage holds one: of each window of ``length`` bytes, the
place of the smallest hash of a gram inside it, the first of equal ones, is an
anchor. Equal windows have their anchor at the same place, so a repeated window
shows as two anchors of the same gram.

1. Every text yields its anchors. An anchor stands for the windows of which it is
   the smallest, which are consecutive, and has a hash of all bytes of these.
   Equal hashes within a task are folded, so that copies cost one row a task.
2. Anchors meet by gram. Those with an equal in all bytes are covered as a whole:
   this settles copies and the inside of passages. Only where a gram has different
   surroundings, one anchor of each kind is passed on.
3. For these the surrounding bytes are fetched from the texts. Per gram they are
   put in suffix order, the lengths of common prefixes are scanned with a stack,
   and each interval of suffixes is divided by what stands to the left, scanned in
   the same way. Intervals that can be extended to neither side are the maximal
   repeats of these surroundings; what they cover is given, not a list of all
   occurrences in documents.
4. A text loses the union of its occurrences of at least ``length`` bytes.

A gram with more than ``group_limit`` kinds of surroundings is not taken into one
task: the windows of its anchors are compared by a 128-bit hash, counted before
and after the shuffle. Both ways are exact but for equal hashes of different
bytes (64 bits twice in step 2).

Defined results: a null text is empty; texts shorter than ``length`` keep all.
Repeated rows are documents of their own and so repeat each other. Other columns
are passed on, but for those of the names of the results, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_intdigest

from rankloom.session import shared_folder

LENGTH = 200
PIECE = 1 << 20
# Room for a distance from the anchor, and for the state, in a packed number.
BITS, STATES = 10, 2
SINGLE, FOLDED, DONE = range(3)
_PLACE = np.uint64((1 << 22) - 1)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def gram_width(length: int) -> int:
    """The largest power of two up to a quarter of the length."""
    return 1 << max(0, (length // 4).bit_length() - 1)


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` bytes (a power of two) at every place, put together from halves."""
    found, step = (data.astype(np.uint64) + np.uint64(1)) * _A, 1
    while step < width:
        found = found[:-step] * _B + (found[step:] ^ (found[step:] >> np.uint64(31))) * _C
        step *= 2
    return found ^ (found >> np.uint64(29))


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` consecutive values."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span :]) if width > span else values


def _powers(base: np.uint64, number: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(number - 1, base, np.uint64)]))


class Scanner:
    """Finds the anchors of pieces of text laid end to end."""

    def __init__(self, length: int):
        self.length, self.gram = length, gram_width(length)
        size = PIECE + 2 * length + (1 << 17)
        self.powers, self.inverse = _powers(_A, size), _powers(np.uint64(pow(int(_A), -1, 1 << 64)), size)

    def anchors(self, data: np.ndarray, begins: np.ndarray, sizes: np.ndarray):
        """(piece, place in it, low, high, gram hash, hash of all bytes) of every anchor.

        An anchor is the smallest of the windows that begin from ``high`` to ``low`` bytes before it.
        """
        windows = np.maximum(sizes - self.length + 1, 0)
        if not windows.sum():
            return [np.empty(0, np.int64)] * 4 + [np.empty(0, np.uint64)] * 2
        grams = gram_hashes(data, self.gram)
        ranked = grams & ~_PLACE | np.arange(len(grams), dtype=np.uint64)
        least = window_minima(ranked, self.length - self.gram + 1)
        piece = np.repeat(np.arange(len(sizes)), windows)
        before = np.cumsum(windows) - windows
        start = np.arange(len(piece)) - np.repeat(before - begins, windows)
        anchor = (least[start] & _PLACE).astype(np.int64)
        change = np.flatnonzero((anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])) + 1
        first, last = np.concatenate([[0], change]), np.concatenate([change, [len(piece)]]) - 1
        at, piece, begin, end = anchor[first], piece[first], start[first], start[last] + self.length
        sums = np.concatenate([[np.uint64(0)], np.cumsum(grams * self.powers[: len(grams)])])
        whole = (sums[end - self.gram + 1] - sums[begin]) * self.inverse[begin]
        low, high = at - start[last], at - begin
        whole = (whole ^ (whole >> np.uint64(32))) * _B + ((low << BITS) + high).astype(np.uint64) * _C
        return piece, at - begins[piece], low, high, grams[at], whole


def _pieces(batches: Iterator[pa.RecordBatch], length: int):
    """Lists of (key, place in the text, bytes), about ``PIECE`` bytes each; pieces of a text share length - 1 bytes."""
    held, size = [], 0
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        for key, text in zip(batch.column(0).to_pylist(), texts, strict=True):
            value = text.as_buffer()
            if value is None or value.size < length:
                continue
            for at in range(0, value.size - length + 1, PIECE):
                part = value[at : min(value.size, at + PIECE + length - 1)]
                if size + part.size > PIECE + length and held:
                    yield held
                    held, size = [], 0
                held.append((key, at, part))
                size += part.size
    if held:
        yield held


ANCHOR_SCHEMA = pa.schema({"gram": pa.int64(), "whole": pa.int64(), "key": pa.int64(), "pack": pa.int64()})


def _fold(key, pack, gram, whole) -> pa.RecordBatch:
    """One row for anchors equal in all bytes; the others of them are done and travel under their text's key."""
    order = np.lexsort((pack, key, whole, gram))
    key, pack, gram, whole = key[order], pack[order], gram[order], whole[order]
    same = np.concatenate([[False], (gram[1:] == gram[:-1]) & (whole[1:] == whole[:-1]), [False]])
    state = np.where(same[:-1], DONE, np.where(same[1:], FOLDED, SINGLE))
    gram = np.where(state == DONE, key.view(np.uint64), gram)
    made = (gram.view(np.int64), whole.view(np.int64), key, pack | state)
    return pa.RecordBatch.from_arrays([pa.array(m) for m in made], schema=ANCHOR_SCHEMA)


def anchors(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(gram, whole, key, pack) of all anchors of ``docs`` (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, held, rows = Scanner(length), [], 0
        for pieces in _pieces(batches, length):
            data = np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8)
            sizes = np.array([p.size for _, _, p in pieces])
            piece, at, low, high, gram, whole = scanner.anchors(data, np.cumsum(sizes) - sizes, sizes)
            key = np.array([k for k, _, _ in pieces], np.int64)[piece]
            at = at + np.array([a for _, a, _ in pieces], np.int64)[piece]
            held.append((key, ((at << BITS | low) << BITS | high) << STATES, gram, whole))
            rows += len(at)
            if rows > 400_000:
                yield _fold(*map(np.concatenate, zip(*held, strict=True)))
                held, rows = [], 0
        if held:
            yield _fold(*map(np.concatenate, zip(*held, strict=True)))

    return docs.select("key", "text").mapInArrow(run, "gram long, whole long, key long, pack long")


def marks(found: DataFrame) -> DataFrame:
    """(key, begin, end, gram, pack, covered, asked): anchors covered as a whole, and those to be compared."""
    same = "partition by gram order by whole, key, pack"
    rows = found.selectExpr(
        "gram", "key", "pack", "pack & 3 as state", "whole",
        f"lag(whole) over ({same}) as before", f"lead(whole) over ({same}) as after",
        f"min(whole) over ({same} rows between unbounded preceding and unbounded following) "
        f"<> max(whole) over ({same} rows between unbounded preceding and unbounded following) as mixed",
    )
    marked = rows.selectExpr(
        "gram", "key", "pack",
        "state > 0 or whole <=> before or whole <=> after as covered",
        f"state < {DONE} and mixed and not whole <=> before as asked",
    ).where("covered or asked")
    return marked


def _unpacked(pack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, low and high of packed anchors."""
    room = (1 << BITS) - 1
    return pack >> (2 * BITS + STATES), pack >> (BITS + STATES) & room, pack >> STATES & room


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    size = min(len(a), len(b))
    differ = int.from_bytes(a[:size], "big") ^ int.from_bytes(b[:size], "big")
    return size - (differ.bit_length() + 7) // 8


def intervals(shared: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(value, first, last) of the interval tree of ``shared[i]``, what items i and i + 1 have in common.

    A stack scan; an interval is a largest run of items that share ``value``, at least ``least``.
    """
    stack = []
    for i, value in enumerate([*shared, -1]):
        first = i
        while stack and stack[-1][0] > value:
            top, first = stack.pop()
            yield top, first, i
        if value >= least and (not stack or stack[-1][0] < value):
            stack.append((value, first))


def maximal_repeats(rights: list[bytes], lefts: list[bytes], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes to the left, bytes to the right, members) of the maximal repeats around one gram.

    ``rights`` are the texts from the anchors on, ``lefts`` those before them,
    reversed. A repeat has at least ``length`` bytes; its members share no longer
    text on either side.
    """
    suffixes = sorted(range(len(rights)), key=rights.__getitem__)
    shared = [common(rights[a], rights[b]) for a, b in zip(suffixes, suffixes[1:], strict=False)]
    left_rank = {m: k for k, m in enumerate(sorted(range(len(lefts)), key=lefts.__getitem__))}
    suffix_rank = {m: k for k, m in enumerate(suffixes)}
    longest_left = max(map(len, lefts))
    for right, first, last in intervals(shared, max(1, length - longest_left)):
        members = sorted(suffixes[first : last + 1], key=left_rank.__getitem__)
        before = [common(lefts[a], lefts[b]) for a, b in zip(members, members[1:], strict=False)]
        if max(before) < length - right:
            continue
        for left, begin, end in intervals(before, max(0, length - right)):
            group = members[begin : end + 1]
            ranks = [suffix_rank[m] for m in group]
            # Left diversity holds for an interval; to the right all may still share more.
            if min(shared[min(ranks) : max(ranks)]) == right:
                yield left, right, group


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def repeats(surroundings: DataFrame, length: int, groups: bool = False) -> DataFrame:
    """Maximal repeats by gram: what of each anchor's text they cover, (key, begin, end).

    All repeats around an anchor hold it, so together they cover one span, and
    an anchor makes one row at most. With ``groups`` every occurrence among
    ``surroundings`` is given: (key, begin, end, gram, number), where gram and
    number name the repeat. These are not all occurrences in documents: equal
    surroundings are there once, and repeats end where they do.
    """

    def of_gram(members: list[tuple[int, int, bytes]], gram: int) -> list[tuple]:
        places, _, highs = (x.tolist() for x in _unpacked(np.array([m[1] for m in members])))
        rights = [m[2][h:] for m, h in zip(members, highs, strict=True)]
        lefts = [m[2][:h][::-1] for m, h in zip(members, highs, strict=True)]
        found = maximal_repeats(rights, lefts, length)
        if groups:
            return [(members[m][0], places[m] - left, places[m] + right, gram, k) for k, (left, right, group) in enumerate(found) for m in group]
        reach = {}
        for left, right, group in found:
            for m in group:
                before, after = reach.get(m, (0, 0))
                reach[m] = max(left, before), max(right, after)
        return [(members[m][0], places[m] - left, places[m] + right) for m, (left, right) in reach.items()]

    names = ["key", "begin", "end", "gram", "number"] if groups else ["key", "begin", "end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, members = None, []
        for batch in batches:
            out = []
            for g, key, pack, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != gram:
                    if len(members) > 1:
                        out += of_gram(members, gram)
                    gram, members = g, []
                members.append((key, pack, text))
            yield _rows(out, names)
        yield _rows(of_gram(members, gram) if len(members) > 1 else [], names)

    met = surroundings.repartition("gram").sortWithinPartitions("gram")
    return met.select("gram", "key", "pack", "around").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def repeated_windows(surroundings: DataFrame, length: int) -> DataFrame:
    """(key, begin, end) of all windows that repeat, for grams with too many surroundings for one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = []
                keys, packs, texts = (c.slice(at, 1024).to_pylist() for c in batch.columns)
                places, _, highs = (x.tolist() for x in _unpacked(np.array(packs)))
                for key, place, high, text in zip(keys, places, highs, texts, strict=True):
                    for k in range(len(text) - length + 1):
                        digest = xxh3_128_intdigest(text[k : k + length])
                        rows.append((key, place - high + k, digest >> 65, digest & (1 << 63) - 1))
                yield _rows(rows, ["key", "begin", "w1", "w2"])

    windows = surroundings.select("key", "pack", "around").mapInArrow(run, "key long, begin long, w1 long, w2 long")
    often = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1")
    return windows.join(often, ["w1", "w2"]).select("key", "begin", (F.col("begin") + length).alias("end"))


def surroundings(docs: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """``asked`` (key, gram, pack) with ``around``: the bytes of all windows of the anchor."""
    wanted = asked.groupBy("key").agg(F.collect_list(F.struct("gram", "pack")).alias("_wanted"))
    met = docs.join(wanted, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for at in range(0, batch.num_rows, 256):
                grams, keys, packs, around = [], [], [], []
                for key, text, wanted in zip(*(c.slice(at, 256).to_pylist() for c in (batch.column("key"), texts, batch.column("_wanted"))), strict=True):
                    places, lows, highs = _unpacked(np.array([w["pack"] for w in wanted]))
                    for w, a, low, high in zip(wanted, places.tolist(), lows.tolist(), highs.tolist(), strict=True):
                        grams.append(w["gram"])
                        keys.append(key)
                        packs.append(w["pack"])
                        around.append(text[a - high : a - low + length])
                columns = [pa.array(x, t) for x, t in ((grams, pa.int64()), (keys, pa.int64()), (packs, pa.int64()), (around, pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, ["gram", "key", "pack", "around"])

    return met.mapInArrow(run, "gram long, key long, pack long, around binary")


RESULTS = {"n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType()}


def without_repeats(docs: DataFrame, length: int = LENGTH, group_limit: int = 32_768, as_text: bool = False) -> DataFrame:
    """``docs`` (with a ``text``) with n_bytes, n_removed, n_spans and ``kept``, the bytes that are left.

    ``as_text`` gives ``kept`` as a string, without what remains of cut characters.
    """
    if not 16 <= length < 1 << BITS:
        raise ValueError(f"a length from 16 to {(1 << BITS) - 1} is needed")
    shared_folder(docs.sparkSession)
    results = RESULTS | {"kept": T.StringType() if as_text else T.BinaryType()}
    fields = [f for f in docs.schema if f.name not in results]
    # Other columns travel under numbers, so their names can't clash.
    numbered = [F.col(f"`{f.name}`").alias("text" if f.name == "text" else f"c{k}") for k, f in enumerate(fields)]
    # Rows of equal id and text share a key; their results are equal too.
    hashed = [F.col(c) for c in ("doc_id", "text") if c in docs.columns]
    keyed = docs.select(*numbered, F.xxhash64(*hashed).alias("key"))
    columns = keyed.columns[:-1]
    found = marks(anchors(keyed, length)).checkpoint()
    asked = found.where("asked").select("key", "gram", "pack")
    hot = asked.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > group_limit).select("gram").checkpoint()
    place, high = F.expr(f"pack >> {2 * BITS + STATES}"), F.expr(f"pack >> {STATES} & {(1 << BITS) - 1}")
    low = F.expr(f"pack >> {BITS + STATES} & {(1 << BITS) - 1}")
    covers = found.where("covered").select("key", (place - high).alias("begin"), (place - low + length).alias("end"))
    if hot.isEmpty():
        covers = covers.unionAll(repeats(surroundings(keyed, asked, length), length))
    else:
        few, many = asked.join(hot, "gram", "left_anti"), asked.join(hot, "gram", "left_semi")
        covers = covers.unionAll(repeats(surroundings(keyed, few, length), length))
        covers = covers.unionAll(repeated_windows(surroundings(keyed, many, length), length))
    spans = covers.groupBy("key").agg(F.collect_set(F.struct("begin", "end")).alias("_spans"))
    met = keyed.join(spans, "key", "left")
    schema = T.StructType([*fields, *(T.StructField(n, t) for n, t in results.items())])
    kinds = [pa.int64()] * 3 + [pa.string() if as_text else pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = batch.column("text").cast(pa.binary()).to_pylist()
                rows = [_cut(t or b"", f or ()) for t, f in zip(texts, batch.column("_spans").to_pylist(), strict=True)]
                if as_text:
                    rows = [(*r[:3], r[3].decode("utf-8", "ignore")) for r in rows]
                made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *made], schema.names)

    return met.mapInArrow(run, schema)


def _cut(text: bytes, spans: list[dict]) -> tuple[int, int, int, bytes]:
    """n_bytes, n_removed, n_spans and what is left of a text without the union of the spans."""
    kept, done, removed, number = [], 0, 0, 0
    for begin, end in sorted((s["begin"], s["end"]) for s in spans):
        if begin > done or not number:
            number += 1
            kept.append(text[done:begin])
            done = begin
        if end > done:
            removed, done = removed + end - done, end
    kept.append(text[done:])
    return len(text), removed, number, b"".join(kept)
