"""Mixing sources to target weights by pivotal rounding of copy numbers.

The sources share the words of the corpus by weight; no target exceeds ``most``
times its source's words, and what a full source can't take goes to the others
by weight. A document of a source is wanted target / words times: so many whole
copies, and one more with the probability that is left.

These fractional probabilities are rounded together, so that a source's words
come out as wanted and not only on average. A pivotal step pairs the largest
document still open with the next ones, just so many that their mass (words
times probability) can carry it, and moves mass between the two sides, up or
down at random, until one becomes integral. Every document keeps its own
probability, the source its sum, and what is open in the end is small.

Documents meet in a reduction tree: by source and a hash into leaves of some
``LEAF``, each of which passes its ``KEEP`` last open documents on; ``FAN`` nodes
meet in one until a source has a single one, whose last open document is rounded
by its probability. Rows on their way are written to the shared folder level by
level. A source of any size is thus dealt over many tasks, none of which holds
more than ``HELD`` rows; sources of more than a 64th of all rows, of which there
are fewer than 64, get their targets by broadcast and the others by a join.

Defined results: a null text has no words; a document without words is never
taken; a null source is a source of its own, the last. The random numbers depend
on the seed, the source and the place in the tree, and rows are in order of size
and a hash of all their columns, so reruns agree, and equal rows may get
different copies among themselves. An empty table gives an empty result. Other
columns are passed on, but for those of the names of the results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from rankloom.llm.batches import short
from rankloom.session import materialise

LEAF, FAN, KEEP, HELD, HOT = 4096, 64, 16, 16384, 64
_NEAR = 1e-9


def with_size(docs: DataFrame, text: str = "text", size: str = "size") -> DataFrame:
    """``docs`` with the number of words of ``text`` instead of it."""
    kept = [f for f in docs.schema if f.name not in (text, size)]
    schema = T.StructType([*kept, T.StructField(size, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            # Splitting bytes cuts at blanks and at the five controls from tab on, and nowhere else.
            sizes = pa.array([len((t or "").encode().split()) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.column(0).flatten(), sizes], schema.names)

    passed = F.struct(*(F.col(f"`{f.name}`") for f in kept)).alias("passed")
    return docs.select(passed, F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)


def numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with ``number``, from 0 on by code point, null last: ranges are counted, then numbered each on its own."""
    order = [F.col("source").isNull(), F.col("source")]
    dealt = materialise(sources.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    counts = {r["range"]: r["n"] for r in dealt.groupBy("range").agg(F.count("*").alias("n")).collect()}  # one row a range
    before, offsets = 0, []
    for k in sorted(counts):
        offsets.append((k, before))
        before += counts[k]
    if not offsets:
        return dealt.select("*", F.lit(0).cast("long").alias("number")).drop("range")
    offset = F.create_map(*(F.lit(x) for pair in offsets for x in pair))[F.col("range")]
    inside = F.expr("row_number() over (partition by range order by source is null, source)") - 1
    return dealt.withColumn("number", (inside + offset).cast("long")).drop("range")


def targets(sources: DataFrame, weights=(1, 2, 3), most: float = 3) -> DataFrame:
    """(source, docs, source_size, target) from (source, docs, source_size); the weights go round by code point, null last.

    Filling is by a common level: a source gets level * weight or its limit. The
    level rises until the sources under their limits take what is left.
    """
    if most < 1 or min(weights) <= 0:
        raise ValueError("weights are positive, and a source may be taken once at least")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("number") % len(weights) + 1).cast("int"))
    listed = materialise(numbered(sources).withColumns({"weight": weight, "limit": most * F.col("source_size")}))
    total, level = None, 0.0
    full = -1
    while True:
        limited = F.col("limit") <= F.col("weight") * level if total is not None else F.lit(False)
        taken, free, words, now = listed.agg(
            F.sum(F.when(limited, F.col("limit"))), F.sum(F.when(~limited, F.col("weight"))), F.sum("source_size"), F.count_if(limited)
        ).first()
        total = words or 0
        if now == full or not free:
            break
        full, level = now, max(level, (total - (taken or 0)) / free)
    return listed.select("source", "docs", "source_size", F.least(F.col("limit").cast("double"), F.col("weight") * level).alias("target"))


def settle(size: np.ndarray, x: np.ndarray, keep: int, random: np.random.Generator) -> None:
    """Rounds probabilities in place until at most ``keep`` are fractional; sizes are in falling order.

    The sum of size * x stays, unless the last one open is rounded alone.
    """
    open_, head = int(np.count_nonzero((x > 0) & (x < 1))), 0
    while open_ > keep:
        while not 0 < x[head] < 1:
            head += 1
        a, width = float(size[head]), 8
        if open_ == 1:
            x[head] = float(random.random() < x[head])
            return
        while True:
            rest = slice(head + 1, head + 1 + width)
            give = np.minimum(x[rest], 1 - x[rest])
            mass = np.cumsum(give * size[rest])
            if mass[-1] >= a or rest.stop >= len(x):
                break
            width *= 4
        if mass[-1] >= a:
            stop = int(np.searchsorted(mass, a)) + 1
            rest, give, carried = slice(head + 1, head + 1 + stop), give[:stop], mass[stop - 1]
            up, down = (1 - x[head]) * a, x[head] * a
        else:  # all others can't carry it: a step with the next one alone
            other = head + 1 + int(np.flatnonzero(give)[0])
            rest, give, carried = slice(other, other + 1), 1.0, float(size[other])
            up, down = min((1 - x[head]) * a, x[other] * carried), min(x[head] * a, (1 - x[other]) * carried)
        moved = up if random.random() * (up + down) < down else -down
        before = 1 + int(np.count_nonzero((x[rest] > 0) & (x[rest] < 1)))
        x[head] += moved / a
        x[rest] -= moved * give / carried
        for place in (slice(head, head + 1), rest):
            x[place] = np.where(x[place] < _NEAR, 0, np.where(x[place] > 1 - _NEAR, 1, x[place]))
        open_ -= before - int(0 < x[head] < 1) - int(np.count_nonzero((x[rest] > 0) & (x[rest] < 1)))


def _level(rows: DataFrame, level: int, keep: int, seed: int) -> DataFrame:
    """The rows (passed, source, node, size, key, copies, x) after their nodes were settled; x is 0 for those decided."""
    schema = T.StructType([f for f in rows.schema])
    names = schema.names

    def settled(held: list[pa.RecordBatch], random, keep: int) -> tuple[pa.RecordBatch, pa.RecordBatch]:
        """Decided rows and open ones."""
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        size, copies, x = (table.column(names.index(n)).to_numpy().copy() for n in ("size", "copies", "x"))
        settle(size, x, keep, random)
        columns = [*table.columns]
        columns[names.index("copies")] = pa.array(copies + (x == 1))
        columns[names.index("x")] = pa.array(np.where(x == 1, 0, x))
        table, open_ = pa.RecordBatch.from_arrays(columns, names), (x > 0) & (x < 1)
        return tuple(table.take(pa.array(np.flatnonzero(which))) for which in (~open_, open_))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, random = None, [], None
        for batch in batches:
            batch = pa.RecordBatch.from_arrays(batch.columns, names)  # as the open rows come back
            keys = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            begin = 0
            while begin < len(keys):
                if keys[begin] != at:
                    if held:
                        yield from settled(held, random, keep)
                    at, held = keys[begin], []
                    random = np.random.default_rng(xxh64_intdigest(repr((seed, level, at)).encode()))
                end, room = begin, HELD - sum(b.num_rows for b in held)
                while end < len(keys) and keys[end] == at and end - begin < room:
                    end += 1
                held.append(batch.slice(begin, end - begin))
                begin = end
                if sum(b.num_rows for b in held) >= HELD:
                    decided, rest = settled(held, random, max(keep, KEEP))
                    held = [rest]
                    yield decided
        if held:
            yield from settled(held, random, keep)

    return rows.repartition("source", "node").sortWithinPartitions("source", "node", F.desc("size"), "key").mapInArrow(run, schema)


def mix(docs: DataFrame, source: str = "source", size: str = "size", weights=(1, 2, 3), most: float = 3, seed: int = 42) -> DataFrame:
    """``docs`` with source_size, target (both of the source) and copies, the number of times that the mix takes a row."""
    kept = [c for c in docs.columns if c not in ("source_size", "target", "copies")]
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if f.name in kept and not isinstance(f.dataType, T.MapType)]
    rows = materialise(docs.select(
        F.struct(*(F.col(f"`{c}`") for c in kept)).alias("passed"), F.col(f"`{source}`").alias("source"),
        F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0)).alias("size"), F.xxhash64(F.lit(seed), *hashed).alias("key"),
    ))
    counted = rows.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    wanted = materialise(targets(counted, weights, most))
    count, largest = wanted.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.max("docs"), F.lit(0))).first()
    hot = F.col("docs") * HOT > count
    wanted = wanted.withColumnRenamed("source", "of")
    same = F.col("source").eqNullSafe(F.col("of"))
    few, others = F.broadcast(wanted.where(hot)), wanted.where(~hot)
    met = rows.join(few, same).unionByName(rows.join(few.select("of"), same, "left_anti").join(others, same))
    rate = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    height = max(0, math.ceil(math.log(max(1, largest / LEAF), FAN)))
    rows = met.withColumns({"rate": rate, "node": F.pmod("key", F.lit(FAN**height)).cast("long")}).select(
        F.struct("passed", "source_size", "target").alias("passed"), "source", "node", "size", "key",
        F.floor("rate").cast("long").alias("copies"), (F.col("rate") - F.floor("rate")).alias("x"),
    )
    done = []
    for level in range(height + 1):
        settled = materialise(_level(rows, level, KEEP if level < height else 0, seed))
        done.append(settled.where("x = 0"))
        rows = settled.where("x > 0").withColumn("node", F.floor(F.col("node") / FAN))
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    return whole.select("passed.passed.*", "passed.source_size", "passed.target", "copies")
