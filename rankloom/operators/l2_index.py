"""A stored vector index for exact nearest neighbours by Euclidean distance.

``build`` cuts the items into cells round centroids and writes them by cell, with
each item's distance to its centroid; ``search`` reads only cells that may hold a
winner. A query at distance d from a centroid of radius r has no item of that
cell nearer than d - r (triangle inequality). So the cells nearest to a query are
searched first, until they hold k items; the k-th distance found is a bound, and
of the other cells only those with d - r within it are read. The result is that
of a scan.

Centroids are those of a sample of at most ``SAMPLE`` vectors, whose quality
decides how many cells are skipped, never what is found. There are at most
``MOST_CELLS``, so the centroids and the list of cells to be read are small. For a
search, cells are put on shelves, as many as give every task of a shuffle work; a
cell of more than ``SLICE_ROWS`` items may lie on several. A query is sent once to
each shelf that holds a cell of its choice, with the list of its cells as bits, so
vectors without clusters, of which most cells are read, aren't copied once a cell.
More than ``BLOCK_ROWS`` queries of one shelf are searched by blocks, each in a task
of its own.

Items without a vector are left out; equal distances go by item id. An index of
no items finds nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.operators.rank import top_rows
from rankloom.operators.topk import Scorer, query_blocks, score_cells, stacks_of, winners
from rankloom.session import materialise

SAMPLE, MOST_CELLS, SLICE_ROWS, BLOCK_ROWS = 20_000, 1024, 65_536, 65_536
_ROUNDS, _SLACK = 8, 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(column) and len(rows) % len(column):
        raise ValueError("vectors must have one common length")
    return rows.reshape(len(column), -1)


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centres, from products; for choosing only."""
    return (x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)


def centroids(sample: np.ndarray, cells: int, seed: int = 42) -> np.ndarray:
    """Centres of a sample by a few rounds of k-means; empty cells keep their centre."""
    rng = np.random.default_rng(seed)
    different = np.unique(sample, axis=0)
    centres = different[rng.choice(len(different), min(cells, len(different)), replace=False)]
    for _ in range(_ROUNDS):
        nearest = np.concatenate([_squares(sample[k : k + 4096], centres).argmin(axis=1) for k in range(0, len(sample), 4096)])
        count = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def build(items: DataFrame, path: str, cells: int | None = None, seed: int = 42) -> None:
    """Write an index of ``items`` (item_id, vector and other columns) to a folder."""
    spark = items.sparkSession
    given = items.where(F.col("vector").isNotNull())
    total = given.count()
    if cells is None:
        cells = max(1, min(MOST_CELLS, round(total**0.5)))
    if not 1 <= cells <= MOST_CELLS:
        raise ValueError(f"between 1 and {MOST_CELLS} cells")
    share = F.pmod(F.xxhash64("item_id", F.lit(seed)), F.lit(max(1, total // SAMPLE))) == 0
    table = given.where(share).select("vector").limit(SAMPLE).toArrow()
    centres = centroids(_matrix(table.column("vector").combine_chunks()), cells, seed) if table.num_rows else np.empty((0, 0))
    shared = spark.sparkContext.broadcast(centres)
    names = [c for c in items.columns if c not in ("cell", "slice", "distance")]
    schema = T.StructType([*(items.schema[c] for c in names), T.StructField("cell", T.IntegerType()), T.StructField("distance", T.DoubleType())])

    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vector"))
            cell = np.concatenate([_squares(x[at : at + 1024], shared.value).argmin(axis=1) for at in range(0, len(x), 1024)])
            apart = np.sqrt(((x - shared.value[cell]) ** 2).sum(axis=1))
            if not np.isfinite(apart).all():
                raise ValueError("vectors must give finite distances")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(apart)], schema.names)

    assigned = materialise(given.select(*names).mapInArrow(assign, schema))
    listed = assigned.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).collect()  # one row a cell
    listed = sorted((r["cell"], r["n"], -(-r["n"] // SLICE_ROWS), r["radius"], centres[r["cell"]].tolist()) for r in listed)
    about = spark.createDataFrame(listed, "cell int, n long, slices int, radius double, centre array<double>")
    slices = F.broadcast(about.select("cell", "slices"))
    sliced = assigned.join(slices, "cell").withColumn("slice", F.pmod(F.xxhash64("item_id"), "slices").cast("int")).drop("slices")
    sliced.repartition("cell", "slice").sortWithinPartitions("cell", "distance").write.partitionBy("cell").parquet(f"{path}/items")
    about.coalesce(1).write.parquet(f"{path}/cells")


@dataclass
class L2Index:
    """A stored index: what is known of its cells, and where its items lie."""

    spark: SparkSession
    path: str
    cells: dict[str, np.ndarray]

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> L2Index:
        table = spark.read.parquet(f"{path}/cells").orderBy("cell").toArrow()
        known = {c: table.column(c).to_numpy() for c in ("cell", "n", "slices", "radius")}
        known["centre"] = _matrix(table.column("centre").combine_chunks()) if table.num_rows else np.empty((0, 0))
        return cls(spark, path, known)

    def _choose(self, queries: DataFrame, k: int, decimals: int | None) -> DataFrame:
        """``queries`` with ``chosen``, the cells to be read as bits: the nearest ones, or, given a ``bound``, the others within it."""
        shared = self.spark.sparkContext.broadcast(self.cells)
        bounded = "bound" in queries.columns
        schema = T.StructType([*queries.schema, T.StructField("chosen", T.BinaryType()), T.StructField("n_chosen", T.IntegerType())])
        slack = 0.0 if decimals is None else 10.0**-decimals

        def run(batches):
            cells = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix(batch.column("vector"))
                chosen = np.zeros((len(x), len(cells["cell"])), bool)
                bounds = batch.column("bound").to_numpy(zero_copy_only=False) if bounded else np.zeros(len(x))
                for mine, row, bound in zip(chosen, x, bounds, strict=True):
                    apart = np.sqrt(((cells["centre"] - row) ** 2).sum(axis=1))
                    order = np.argsort(apart, kind="stable")
                    first = int(np.searchsorted(np.cumsum(cells["n"][order]), k)) + 1
                    if bounded:
                        rest = order[first:]
                        least = np.maximum(0, apart[rest] - cells["radius"][rest] - _SLACK * (apart[rest] + cells["radius"][rest]))
                        mine[rest[least**2 <= bound * (1 + _SLACK) + slack]] = True
                    else:
                        mine[order[:first]] = True
                bits = np.packbits(chosen, axis=1)
                made = pa.array([row.tobytes() for row in bits], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, made, pa.array(chosen.sum(axis=1), pa.int32())], schema.names)

        return queries.mapInArrow(run, schema)

    def _shelves(self, wanted: int) -> list[tuple[int, int, int, int]]:
        """(place of the cell, cell, slice, shelf): all cells in order on about ``wanted`` shelves of like numbers of items."""
        units = [(at, int(c), s, n / k) for at, (c, n, k) in enumerate(zip(self.cells["cell"], self.cells["n"], self.cells["slices"], strict=True)) for s in range(k)]
        size = sum(u[3] for u in units) / wanted
        before = np.cumsum([0.0] + [u[3] for u in units])
        return [(at, c, s, min(wanted - 1, int(x / size))) for (at, c, s, _), x in zip(units, before[:-1], strict=True)]

    def _found(self, chosen: DataFrame, k: int, payload, decimals: int | None) -> DataFrame:
        """The best k items of every query in each shelf that holds one of its chosen cells."""
        width = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        units, many = self._shelves(max(1, -(-width // stacks_of(chosen.count(), width)))), len(self.cells["cell"])
        holds = np.zeros((many, units[-1][3] + 1), np.float32)
        for at, _, _, shelf in units:
            holds[at, shelf] = 1
        shared = self.spark.sparkContext.broadcast(holds)

        def opened(batch):
            bits = np.frombuffer(b"".join(batch.column("chosen").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            return np.unpackbits(bits, axis=1, count=many)

        def count(batches):
            for batch in batches:
                if batch.num_rows:
                    bits = opened(batch)
                    n = np.concatenate([bits.sum(axis=0, dtype=np.int64), (bits @ shared.value > 0).sum(axis=0)])
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], ["place", "n"])

        def deal(batches):
            for batch in batches:
                if batch.num_rows:
                    query, shelf = np.nonzero(opened(batch) @ shared.value > 0)
                    at = np.searchsorted(query, np.arange(batch.num_rows + 1))
                    lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(shelf, pa.int32()))
                    yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "shelves"])

        # One row a cell and one a shelf.
        counted = chosen.select("chosen").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
        asked = {r["place"]: r["n"] for r in counted if r["n"]}
        blocks = {shelf: stacks_of(asked[many + shelf], width, BLOCK_ROWS) for shelf in range(holds.shape[1]) if many + shelf in asked}
        read = [(at, c, s, shelf, blocks[shelf]) for at, c, s, shelf in units if at in asked]
        place = F.broadcast(self.spark.createDataFrame(read, "place int, cell int, slice int, shelf int, blocks int"))
        items = self.spark.read.parquet(f"{self.path}/items").where(F.col("cell").isin(sorted({c for _, c, *_ in read})))
        each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        left = items.select("item_id", "vector", *payload, "cell", "slice").join(place, ["cell", "slice"])
        left = left.select("shelf", each.alias("block"), F.struct("item_id", "vector", *payload, F.col("place").alias("cell")).alias("item"))
        bound = F.col("bound") if "bound" in chosen.columns else F.lit(None).cast("double").alias("bound")
        right = chosen.select("query_id", "vector", F.lit(None).cast("string").alias("wanted"), "chosen", bound)
        schema = T.StructType([*right.schema, T.StructField("shelves", T.ArrayType(T.IntegerType()))])
        right = right.mapInArrow(deal, schema).select("*", F.explode("shelves").alias("shelf")).select("shelf", F.struct(*right.columns, "shelf").alias("query"))
        shape = F.broadcast(self.spark.createDataFrame(list(blocks.items()), "shelf int, blocks int"))
        right = right.join(shape, "shelf").select("shelf", F.pmod(F.xxhash64("query.query_id"), "blocks").cast("int").alias("block"), "query")

        def scorer(table):
            # Queries of like choices share a block, of which a cell that none has chosen isn't scored.
            bits = opened(table)
            mine = holds[:, table.column("shelf")[0].as_py()] > 0
            order = np.lexsort(np.packbits(bits[:, mine], axis=1).T[::-1])
            table, bits = table.take(pa.array(order)), bits[order].astype(bool)
            bounds = table.column("bound").to_numpy()
            slack = 0.0 if decimals is None else 10.0**-decimals
            floor = np.where(np.isnan(bounds), -np.inf, -bounds * (1 + _SLACK) - slack)
            queries = query_blocks(table)
            for block in queries:
                block |= {"allowed": bits[block["rows"]], "floor": floor[block["rows"]]}
            return Scorer(queries, table.column("query_id").combine_chunks(), k, "l2", list(payload), decimals)

        return score_cells(right, left, ["shelf", "block"], winners(items, chosen, payload), scorer)

    def _two_steps(self, queries: DataFrame, k: int, payload, decimals: int | None):
        """(winners of the first cells, queries with their other cells, queries with their first cells)."""
        first = materialise(self._choose(queries.where(F.col("vector").isNotNull()).select("query_id", "vector"), k, decimals))
        best = [F.col("score_key").desc(), F.col("item_id").asc()]
        found = materialise(top_rows(self._found(first, k, payload, decimals), ["query_id"], best, k).drop("rank"))
        bound = found.groupBy("query_id").agg(F.count("*").alias("n"), (-F.min("score")).alias("bound"))
        # Fewer than k rows mean that the first cells were all there are.
        bounded = first.drop("chosen", "n_chosen").join(bound.where(F.col("n") >= k).drop("n"), "query_id")
        return found, materialise(self._choose(bounded, k, decimals)), first

    def search(self, queries: DataFrame, k: int, payload=(), decimals: int | None = None) -> DataFrame:
        """The k nearest items of each query: (query_id, item_id, rank, distance, payload); distance is squared."""
        if k < 1:
            raise ValueError("k must be at least 1")
        if not len(self.cells["cell"]):
            return queries.where("false").select("query_id", *(F.lit(None).cast(t).alias(c) for c, t in (("item_id", "long"), ("rank", "int"), ("distance", "double"))))
        found, rest, _ = self._two_steps(queries, k, payload, decimals)
        more = self._found(rest, k, payload, decimals)
        best = [F.col("score_key").desc(), F.col("item_id").asc()]
        ranked = top_rows(found.unionByName(more), ["query_id"], best, k)
        return ranked.withColumn("distance", F.abs("score")).drop("score", "score_key")

    def cells_read(self, queries: DataFrame, k: int, decimals: int | None = None) -> DataFrame:
        """(query_id, cells_read, cells): how much of the index a search of these queries reads."""
        _, rest, first = self._two_steps(queries, k, (), decimals)
        read = first.unionByName(rest.drop("bound")).groupBy("query_id").agg(F.sum("n_chosen").cast("int").alias("cells_read"))
        return read.withColumn("cells", F.lit(len(self.cells["cell"])))
