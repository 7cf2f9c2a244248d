"""Near-duplicates by SimHash, found with an embedding of segment bit counts.

Every text gets a 64-bit fingerprint of its word shingles. Fingerprints link at
a few differing bits, and linked ones form classes.

Candidates come from a grid. A fingerprint is cut into segments of two bits, and
each is mapped to its number of set bits. A differing bit moves one of these
counts by at most one, so the Manhattan distance of two count vectors is a lower
bound of the number of differing bits. If that is at most ``bits``, then in one
of the two halves the count vectors are at most ``bits // 2`` apart. A
fingerprint is entered, for each half, into the grid cell of its count vector
and into all cells one step away; vectors two steps apart share a cell, that
between them. Members of a cell are compared exactly.

Only different fingerprints are compared, so copies cost nothing. Of a cell's
links no more than a spanning forest is passed on. Cells with more members than
``cell_limit`` are cut into blocks, and every pair of blocks is a group of its
own, so each pair still meets and no task takes a whole cell. Classes are found
by alternating large-star and small-star steps, each written to the shared
folder.

Defined results: a null or blank text has no words and the fingerprint zero,
which links like any other. Repeated rows have equal results. A class is named
by its smallest doc_id; nulls count as ids only where there is no other. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from rankloom.llm.batches import short
from rankloom.session import shared_folder

SEED = 42
# Of each byte, its bits as eight lanes of one byte.
_LANES = np.array([sum((b >> i & 1) << 8 * i for i in range(8)) for b in range(256)], np.uint64)
_POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def shingles(text: str | None, words: int) -> np.ndarray:
    """The hashes of a text's word shingles, in order; a text of fewer words is one shingle."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return np.empty(0, "<u8")
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(words, len(tokens))
    spans = zip(starts[: len(tokens) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], "<u8")


def folded(hashes: np.ndarray) -> int:
    """The SimHash of shingle hashes, as a signed number."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # a lane holds up to 255 rows
        lanes = _LANES[hashes[at : at + (1 << 16)].view(np.uint8)].reshape(-1, 8)
        sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
        counts += sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int((_POWERS[2 * counts > len(hashes)]).sum(dtype=np.uint64).astype(np.int64))


def fingerprint(text: str | None, words: int = 4) -> int:
    """The SimHash of a text's word shingles, as a signed number."""
    return folded(shingles(text, words))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, fp) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            made = pa.array([fingerprint(t) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), made], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(run, "doc_id long, fp long")


def cells_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into fps, cell) of every grid entry of uint64 fingerprints."""
    rows, cells = [], []
    odd = np.uint64(0x55555555)
    for half in range(2):
        bits = fps >> np.uint64(32 * half) & np.uint64(0xFFFFFFFF)
        counts = ((bits & odd) + (bits >> np.uint64(1) & odd)).astype(np.int64)
        name = np.int64(half << 32)
        rows.append(np.arange(len(fps)))
        cells.append(counts + name)
        for segment in range(16):
            count, step = counts >> 2 * segment & 3, np.int64(1 << 2 * segment)
            for moved, there in ((counts + step, count < 2), (counts - step, count > 0)):
                rows.append(np.flatnonzero(there))
                cells.append(moved[there] + name)
    return np.concatenate(rows), np.concatenate(cells)


def entries(fps: DataFrame) -> DataFrame:
    """(cell, fp): where each of the different fingerprints is entered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(0).to_numpy(zero_copy_only=False)
            row, cell = cells_of(known.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(known[row])], ["cell", "fp"])

    return fps.select("fp").mapInArrow(run, "cell long, fp long")


def linked(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among uint64 fingerprints, as two index arrays."""
    if len(fps) <= 1024:
        a, b = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= bits, 1))
        if len(a) <= 2 * len(fps):
            return a, b
    left, right, open_ = [], [], np.ones(len(fps), bool)
    for root in range(len(fps)):
        reached = [root] if open_[root] else []
        open_[root] = False
        while reached:
            node = reached.pop()
            rest = np.flatnonzero(open_)
            near = rest[np.bitwise_count(fps[rest] ^ fps[node]) <= bits]
            open_[near] = False
            left += [node] * len(near)
            right += near.tolist()
            reached += near.tolist()
    return np.array(left, np.int64), np.array(right, np.int64)


def links(fps: DataFrame, bits: int = 4, cell_limit: int = 4096) -> DataFrame:
    """Distinct (a, b) of fingerprints at most ``bits`` apart that connect all classes; ``fps`` are distinct."""
    if not 0 <= bits <= 5:
        raise ValueError("two halves and one step each serve up to five differing bits")
    entered = entries(fps)
    large = entered.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > cell_limit).checkpoint()
    if large.isEmpty():
        grouped = entered.withColumn("pair", F.lit(0))
    else:
        blocks = F.ceil(F.col("n") / cell_limit).cast("int")
        cut = entered.join(large, "cell", "left").withColumns({
            "blocks": F.coalesce(blocks, F.lit(1)),
            "block": F.coalesce(F.pmod(F.xxhash64("fp"), blocks).cast("int"), F.lit(0)),
        })
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        grouped = cut.select("cell", "fp", "blocks", "block", other.alias("other")).select(
            "cell", "fp", (F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")).alias("pair")
        )
    met = grouped.repartition("cell", "pair").sortWithinPartitions("cell", "pair", "fp")

    def compare(cell, pair, fp):
        """Links of runs of equal (cell, pair); small runs are compared all at once, by distance in the run."""
        bounds = np.flatnonzero((cell[1:] != cell[:-1]) | (pair[1:] != pair[:-1])) + 1
        starts, ends = np.concatenate([[0], bounds]), np.concatenate([bounds, [len(cell)]])
        size, left, right = ends - starts, [], []
        small = np.repeat(size <= 8, size)
        run = np.repeat(np.arange(len(size)), size)
        for step in range(1, 8):
            at = np.flatnonzero(small[:-step] & (run[:-step] == run[step:]))
            if not len(at):
                break
            at = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= bits]
            left.append(fp[at])
            right.append(fp[at + step])
        for k in np.flatnonzero(size > 8):
            members = fp[starts[k] : ends[k]]
            a, b = linked(members, bits)
            left.append(members[a])
            right.append(members[b])
        a, b = (np.concatenate([np.empty(0, np.uint64), *x]).view(np.int64) for x in (left, right))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last run of a batch may go on in the next one; it holds at most two blocks.
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)]
        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = [np.concatenate([h, n.view(np.uint64) if k == 2 else n.astype(np.int64)]) for k, (h, n) in enumerate(zip(held, new, strict=True))]
            if not len(held[0]):
                continue
            open_ = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
            end = open_[-1] + 1 if len(open_) else 0
            if end:
                yield compare(*(h[:end] for h in held))
                held = [h[end:] for h in held]
        if len(held[0]):
            yield compare(*held)

    return met.select("cell", "pair", "fp").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): the smallest node that it can reach."""

    def stars(edges: DataFrame, both: bool) -> DataFrame:
        """Joins neighbours to their smallest one: of larger neighbours, or of smaller ones and the node itself."""
        pairs = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("near"))
        if both:
            pairs = pairs.union(pairs.select("near", "node"))
        least = pairs.groupBy("node").agg(F.min("near").alias("least"))
        met = pairs.join(least.withColumn("least", F.least("least", "node")), "node")
        if both:
            made = met.where("near > node").select(F.col("near").alias("a"), F.col("least").alias("b"))
        else:
            made = met.select(F.explode(F.array("near", "node")).alias("a"), F.col("least").alias("b"))
        return made.where("a <> b").distinct()

    def state(edges: DataFrame):
        return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = edges.where("a <> b").distinct().checkpoint()
    before = None
    while (now := state(edges)) != before:
        before, edges = now, stars(stars(edges, True), False).checkpoint()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def classes(docs: DataFrame, bits: int = 4, cell_limit: int = 4096, text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``."""
    shared_folder(docs.sparkSession)
    known = fingerprints(docs, text).checkpoint()
    different = known.groupBy("fp").agg(F.min("doc_id").alias("least")).checkpoint()
    roots = components(links(different.select("fp"), bits, cell_limit))
    rooted = different.join(roots, different.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(named, "root").select("fp", "component_id")
    return known.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, bits: int = 4, cell_limit: int = 4096) -> DataFrame:
    """One document of each class of fingerprints: that of the smallest doc_id, of those any one text.

    Rows are named by two hashes of id and text, 128 bits together, so unlike texts
    without an id, or under one id, are told apart. Of copies only the first of each
    fingerprint goes on, found map-side; texts are shuffled once, at the end.
    """
    shared_folder(docs.sparkSession)
    row = [F.xxhash64(F.lit(k), "doc_id", "text").alias(f"row_{k}") for k in (1, 2)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            made = pa.array([fingerprint(t) for t in batch.column(3).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], made], ["doc_id", "row_1", "row_2", "fp"])

    named = docs.select(F.col("doc_id").cast("long"), *row, "text").mapInArrow(run, "doc_id long, row_1 long, row_2 long, fp long")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_1", "row_2")
    different = named.groupBy("fp").agg(F.min(first).alias("one")).checkpoint()
    roots = components(links(different.select("fp"), bits, cell_limit))
    rooted = different.join(roots, different.fp == roots.node, "left").select(F.coalesce("root", "fp").alias("root"), "one")
    kept = rooted.groupBy("root").agg(F.min("one").alias("one")).select("one.row_1", "one.row_2")
    # Rows of one name are equal in id and text; they meet by name, so dropping repeats moves nothing again.
    rows = docs.select(F.struct("*").alias("doc"), *row)
    return rows.join(kept, ["row_1", "row_2"]).dropDuplicates(["row_1", "row_2"]).select("doc.*")
