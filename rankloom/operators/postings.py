"""An inverted index of sparse vectors for exact top-k by dot product.

``build`` deals the items into shards by hash and writes, for every shard and
term, the places of the items that hold it with their weights, and the largest
weight of every ``BLOCK`` postings. ``search`` reads only the terms that are asked
for and takes a query's terms in order of the most they can add (MaxScore):

* an item that none of the terms so far has met can still reach at most the sum
  of what the remaining ones add. Once the k-th best score so far is above that,
  no new item is taken in, and postings count only for items met before;
* before that, a block of postings whose largest weight can't lift a new item to
  the k-th best score counts only for items met before.

The result is that of a scan: weights are not negative, every item is a candidate,
and items that share no term with a query fill its list up with score zero,
smallest ids first. Scores rank to twelve significant digits, or rounded to
``decimals``, ties by item id.

A shard holds some ``SHARD_POSTINGS`` postings, a term of a hot shard no more than
the shard has items. Queries beyond ``BLOCK_ROWS`` meet the shards by blocks; none
reaches the driver but the list of different terms, at most the vocabulary.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.operators.rank import top_rows, wide_salts
from rankloom.operators.topk import each, rank_key, score_cells
from rankloom.session import materialise

BLOCK, SHARD_POSTINGS, BLOCK_ROWS = 128, 4_000_000, 8192
_ITEMS = -1  # the term under which a shard lists its items


def build(items: DataFrame, path: str, shard_postings: int = SHARD_POSTINGS) -> None:
    """Write an index of ``items`` (item_id, indices, weights; other columns are kept beside) to a folder."""
    given = materialise(items.where(F.col("item_id").isNotNull()))
    total = given.agg(F.coalesce(F.sum(F.size("indices").cast("long") + 1), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_postings))
    dealt = given.select(F.pmod(F.xxhash64("item_id"), F.lit(shards)).cast("int").alias("shard"), "item_id", "indices", "weights")
    schema = "shard int, term int, item_ids array<long>, weights array<double>, maxima array<double>"

    def shard_rows(shard, held):
        """A row for each term of a shard, its items in order of id."""
        ids, count, terms, weights = (np.concatenate(x) for x in zip(*held, strict=True))
        if len(weights) and weights.min() < 0:
            raise ValueError("weights must not be negative")
        given = np.concatenate([weights != 0, np.ones(len(ids), bool)])
        # Every item is listed once more, without weight.
        terms = np.concatenate([terms, np.full(len(ids), _ITEMS, terms.dtype)])[given]
        weights = np.concatenate([weights, np.zeros(len(ids))])[given]
        ids = np.concatenate([np.repeat(ids, count), ids])[given]
        order = np.lexsort((ids, terms))
        ids, terms, weights = ids[order], terms[order], weights[order]
        first = np.append(np.flatnonzero(np.append(True, terms[1:] != terms[:-1])), len(terms))
        blocks = -(-np.diff(first) // BLOCK)
        opened = np.append(0, np.cumsum(blocks))
        starts = np.repeat(first[:-1], blocks) + BLOCK * (np.arange(opened[-1]) - np.repeat(opened[:-1], blocks))
        maxima = np.maximum.reduceat(weights, starts)
        lists = (pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(v)) for o, v in ((first, ids), (first, weights), (opened, maxima)))
        columns = [pa.array(np.full(len(blocks), shard), pa.int32()), pa.array(terms[first[:-1]], pa.int32()), *lists]
        row = pa.RecordBatch.from_arrays(columns, ["shard", "term", "item_ids", "weights", "maxima"])
        yield from (row.slice(at, 256) for at in range(0, row.num_rows, 256))

    def gather(batches):
        """The postings of one shard after the other; a task holds one."""
        at, held = None, []
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            bounds = np.flatnonzero(shard[1:] != shard[:-1]) + 1
            for a, b in zip([0, *bounds.tolist()], [*bounds.tolist(), len(shard)], strict=True):
                if a == b:
                    continue
                if (here := int(shard[a])) != at:
                    if held:
                        yield from shard_rows(at, held)
                    at, held = here, []
                ids, indices, weights = (batch.column(c).slice(a, b - a) for c in ("item_id", "indices", "weights"))
                count = pc.fill_null(pc.list_value_length(indices), 0).to_numpy(zero_copy_only=False)
                terms, weights = (c.flatten().to_numpy(zero_copy_only=False) for c in (indices, weights))
                held.append((ids.to_numpy().astype(np.int64), count, terms.astype(np.int64), weights.astype(np.float64)))
        if held:
            yield from shard_rows(at, held)

    met = dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(gather, schema)
    met.sortWithinPartitions("term").write.parquet(f"{path}/postings")
    given.drop("indices", "weights").write.parquet(f"{path}/items")


class MaxScore:
    """The best k items of one shard for some queries; ``add`` takes the shard's postings."""

    def __init__(self, table, k: int, decimals: int | None):
        self.ids = table.column("query_id").combine_chunks()
        self.terms = [np.asarray(t, np.int64) for t in table.column("indices").to_pylist()]
        self.weights = [np.asarray(w, np.float64) for w in table.column("weights").to_pylist()]
        self.k, self.decimals, self.items, self.lists = k, decimals, np.empty(0, np.int64), {}

    def add(self, batch) -> None:
        ids, weights, maxima = (batch.column(c) for c in ("item_ids", "weights", "maxima"))
        for row, term in enumerate(batch.column("term").to_pylist()):
            own = ids[row].values.to_numpy()
            if term == _ITEMS:
                self.items = own
            else:
                self.lists[term] = own, weights[row].values.to_numpy(), maxima[row].values.to_numpy()

    def one(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
        """(places, scores, scored postings, postings) of the best items for one query."""
        known = [(w, *self.lists[t]) for t, w in zip(terms.tolist(), weights.tolist(), strict=True) if t in self.lists and w > 0]
        most = np.array([w * maxima.max() for w, _, _, maxima in known])
        order = np.argsort(-most, kind="stable")
        rest = np.append(np.cumsum(most[order][::-1])[::-1], 0.0)
        score, met = np.zeros(len(self.items)), np.zeros(len(self.items), bool)
        scored, least = 0, -1.0
        slack = 1e-9 if self.decimals is None else 1e-9 + 10.0**-self.decimals
        for turn, which in enumerate(order.tolist()):
            weight, places, values, maxima = known[which]
            # What a new item can reach by this block and the terms to come, against the k-th best so far.
            new = weight * maxima + rest[turn + 1] >= least - slack if rest[turn] >= least - slack else np.zeros(len(maxima), bool)
            take = np.repeat(new, BLOCK)[: len(places)] | met[places]
            places = places[take]
            score[places] += weight * values[take]
            met[places] = True
            scored += len(places)
            if turn + 1 < len(order) and np.count_nonzero(met) >= self.k:
                least = np.partition(score[met], -self.k)[-self.k]
        found = np.flatnonzero(met)
        key = rank_key(score[found], self.decimals)
        best = found[np.lexsort((self.items[found], -key))[: self.k]]
        if len(best) < self.k:
            # Items are in order of id; of the first 2k at most k were met.
            spare = np.flatnonzero(~met)[: self.k - len(best)]
            best = np.concatenate([best, spare])
        return best, score[best], scored, sum(len(p) for _, p, _, _ in known)

    def result(self):
        # Lists hold item ids; a query needs places in the shard.
        self.lists = {t: (np.searchsorted(self.items, ids), w, m) for t, (ids, w, m) in self.lists.items()}
        for query, (terms, weights) in enumerate(zip(self.terms, self.weights, strict=True)):
            place, score, scored, postings = self.one(terms, weights)
            n = len(place)
            yield pa.table({
                "query_id": pa.chunked_array([self.ids.take(pa.array(np.full(n, query)))]),
                "item_id": pa.array(self.items[place]),
                "score": pa.array(score),
                "score_key": pa.array(rank_key(score, self.decimals)),
                "scored": pa.array(np.full(n, scored)),
                "postings": pa.array(np.full(n, postings)),
            })


@dataclass
class PostingIndex:
    """A stored index and where it lies."""

    spark: SparkSession
    path: str

    def _winners(self, queries: DataFrame, k: int, decimals: int | None) -> DataFrame:
        """The best k of every query in every shard, with the postings scored and those of its terms."""
        asked = materialise(queries.select("query_id", "indices", "weights"))
        terms = [r[0] for r in asked.select(F.explode("indices")).distinct().collect()]  # at most the vocabulary
        read = self.spark.read.parquet(f"{self.path}/postings").where(F.col("term").isin([_ITEMS, *terms]))
        shards = self.shards()
        blocks = max(1, -(-asked.count() // BLOCK_ROWS))
        block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")
        right = asked.select(block, each(shards).alias("shard"), F.struct("*").alias("query"))
        left = read.select(each(blocks).alias("block"), "shard", F.struct("term", "item_ids", "weights", "maxima").alias("item"))
        found = [("item_id", T.LongType()), ("score", T.DoubleType()), ("score_key", T.DoubleType()), ("scored", T.LongType()), ("postings", T.LongType())]
        schema = T.StructType([asked.schema["query_id"], *(T.StructField(n, t) for n, t in found)])
        return score_cells(right, left, ["block", "shard"], schema, lambda table: MaxScore(table, k, decimals))

    def search(self, queries: DataFrame, k: int, payload=(), decimals: int | None = None) -> DataFrame:
        """The k best items of each query (query_id, indices, weights): (query_id, item_id, score, rank, payload)."""
        if k < 1:
            raise ValueError("k must be at least 1")
        found = self._winners(queries, k, decimals).drop("scored", "postings")
        ranked = top_rows(found, ["query_id"], [F.col("score_key").desc(), F.col("item_id").asc()], k, salts=wide_salts(found))
        ranked = ranked.drop("score_key")
        if not payload:
            return ranked
        return ranked.join(self.spark.read.parquet(f"{self.path}/items").select("item_id", *payload), "item_id")

    def work(self, queries: DataFrame, k: int, decimals: int | None = None) -> DataFrame:
        """(query_id, scored, postings): postings that a search multiplies out, and all those of the query's terms."""
        each_shard = self._winners(queries, k, decimals).where("score is not null")
        once = each_shard.select("query_id", F.pmod(F.xxhash64("item_id"), F.lit(self.shards())).alias("shard"), "scored", "postings").distinct()
        return once.groupBy("query_id").agg(F.sum("scored").alias("scored"), F.sum("postings").alias("postings"))

    def shards(self) -> int:
        return (self.spark.read.parquet(f"{self.path}/postings").agg(F.max("shard")).first()[0] or 0) + 1
