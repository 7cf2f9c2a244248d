"""Exact top-k items of every query, scored block by block inside tasks.

Items are streamed as Arrow batches past a block of queries; each task keeps
only the best ``k`` rows per query, so no (query, item) pair leaves a task
unless it may still win. Queries within one block's bounds are broadcast, and the
items are scanned where they lie. More are dealt into stacks of blocks by hash, the
items into slices, and stacks and slices meet in tasks by a shuffle; of such queries
nothing but their number and size reaches the driver.

Most pairs of dense vectors are only looked at in single precision: what is below a
query's k-th best so far by more than a bound of the error can't win. The others are
scored in double precision, so the result is that of scoring all pairs so.

Vectors are either a dense ``vector`` array or sparse ``indices`` / ``weights``
arrays. Ranking uses the score to twelve significant digits, or to a fixed
number of decimals if one is given, ties by ``item_id``, so it does not depend
on the order of floating-point sums. Scores that are not finite are an error.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions.text import no_type_filter
from rankloom.operators.rank import top_rows, wide_salts
from rankloom.session import shared_folder

BLOCK_ROWS = 65536
BLOCK_BYTES = 64 << 20
# Queries of one task, where there are enough to fill several.
STACK_ROWS = 16384
SIGNIFICANT_BITS = 40
_BLOCK_QUERIES = 256
_CHUNK_ROWS = 4096
_FIRST_ROWS = 1024
# Beyond this share of a chunk, candidates are merged as a whole matrix.
_FEW = 1 / 16
# Squared lengths that single precision of the scaled vectors is good for.
_SAFE = 1e-200, 1e200
_CHUNK_PRODUCTS = 2 << 20
_EMPTY = -np.inf
_NO_ID = np.iinfo(np.int64).max


class _Dense:
    """Rows of a dense vector column."""

    def __init__(self, column):
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        self.rows = len(column)
        if self.rows and flat.size % self.rows:
            raise ValueError("vectors must have one common length")
        self.values = flat.reshape(self.rows, -1)

    def squares(self, rows):
        return _squares(self.values[rows])

    def block(self, rows):
        return {"matrix": self.values[rows]}

    def chunks(self, rows, block):
        """Runs of rows, the first ones short, as they only give a first bound."""
        out, at, step = [], 0, _FIRST_ROWS
        while at < len(rows):
            out.append(rows[at : at + step])
            at, step = at + step, min(2 * step, _CHUNK_ROWS)
        return out

    def products(self, rows, block):
        return block["matrix"] @ self.values[rows].T


def _squares(values):
    return np.einsum("ij,ij->i", values, values)


class _Rough:
    """Dense rows in single precision, scaled so that no product of two is above 1.

    ``safe`` tells whether all are within the range that this is good for.
    """

    def __init__(self, values, metric, centre=None):
        # Distances don't change with the origin, but their error does.
        values = values if centre is None else values - centre
        square = _squares(values)
        zero = square == 0
        self.safe = bool(((square >= _SAFE[0]) & (square <= _SAFE[1]) | zero).all()) and not values[zero].any()
        self.rows = None
        if not self.safe:
            return
        length = np.sqrt(square)
        self.square, self.length = square, np.where(zero, 1.0, length)
        # Lengths matter but for the cosine; here the longest is 1.
        self.top = 1.0 if metric == "cosine" or not length.any() else float(length.max())
        scaled = values / (self.length[:, None] if metric == "cosine" else self.top)
        if metric == "l2":
            # One more axis takes half the square off the product.
            scaled = np.hstack([scaled, -0.5 * (square / self.top / self.top)[:, None]])
        self.rows = scaled.astype(np.float32)

    def only(self, which):
        """Some of the rows."""
        other = copy.copy(self)
        if self.safe:
            other.rows, other.square = self.rows[which], self.square[which]
        return other


class _Sparse:
    """Rows of sparse vectors; a block of queries is kept as postings by axis."""

    def __init__(self, indices, weights):
        lengths = pc.list_value_length(indices).to_numpy(zero_copy_only=False)
        self.rows = len(indices)
        self.start = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
        self.indices = indices.flatten().to_numpy(zero_copy_only=False)
        self.weights = weights.flatten().to_numpy(zero_copy_only=False).astype(np.float64)

    def _entries(self, rows):
        return _spans(self.start[rows], self.start[rows + 1] - self.start[rows])

    def squares(self, rows):
        row, entry = self._entries(rows)
        return np.bincount(row, self.weights[entry] ** 2, len(rows))

    def block(self, rows):
        row, entry = self._entries(rows)
        order = np.argsort(self.indices[entry], kind="stable")
        axis = self.indices[entry][order]
        # Where each axis starts among the postings, and one unused axis.
        start = np.searchsorted(axis, np.arange((axis[-1] if len(axis) else -1) + 3))
        return {"start": start, "query": row[order], "weight": self.weights[entry][order]}

    def _postings(self, rows, block):
        """For every entry of these rows: its row, weight and span of postings."""
        row, entry = self._entries(rows)
        start = block["start"]
        axis = np.minimum(self.indices[entry], len(start) - 2)
        return row, self.weights[entry], start[axis], start[axis + 1] - start[axis]

    def chunks(self, rows, block):
        """Runs of rows with a bounded number of products, one row at least."""
        row, _, _, count = self._postings(rows, block)
        work = np.cumsum(np.bincount(row, count, len(rows)))
        out, at, done = [], 0, 0.0
        while at < len(rows):
            end = int(np.searchsorted(work, done + _CHUNK_PRODUCTS, side="right"))
            end = max(at + 1, min(end, at + _CHUNK_ROWS))
            out.append(rows[at:end])
            at, done = end, work[end - 1]
        return out

    def products(self, rows, block):
        row, weight, first, count = self._postings(rows, block)
        source, posting = _spans(first, count)
        cell = block["query"][posting] * len(rows) + row[source]
        size = len(block["square"]) * len(rows)
        return np.bincount(cell, weight[source] * block["weight"][posting], size).reshape(-1, len(rows))


def _spans(first, count):
    """(which span, position) of every element of the spans first[i] .. first[i] + count[i]."""
    which = np.repeat(np.arange(len(count)), count)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    return which, np.repeat(first, count) + offset


def _plain(column):
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _vectors(table):
    if "vector" in table.schema.names:
        return _Dense(_plain(table.column("vector")))
    return _Sparse(_plain(table.column("indices")), _plain(table.column("weights")))


def query_blocks(table, size: int = _BLOCK_QUERIES) -> list[dict]:
    """Cut a query table into blocks of one wanted type, as plain arrays."""
    vectors = _vectors(table)
    wanted = table.column("wanted").to_pylist()
    blocks = []
    for kind in sorted(set(wanted), key=lambda x: (x is not None, x or "")):
        members = np.flatnonzero([w == kind for w in wanted])
        for at in range(0, len(members), size):
            rows = members[at : at + size]
            blocks.append({"kind": kind, "rows": rows, "square": vectors.squares(rows), **vectors.block(rows)})
    return blocks


def rank_key(score, decimals):
    """What scores are ranked by: rounded to decimals, or relative to their size."""
    if decimals is not None:
        # Beyond 2^53 in units of the last decimal there is nothing to round.
        return np.where(np.abs(score) < 2.0**53 / 10.0**decimals, np.round(np.clip(score, -1e300, 1e300), decimals), score) + 0.0
    mantissa, exponent = np.frexp(score)
    return np.ldexp(np.rint(np.ldexp(mantissa, SIGNIFICANT_BITS)), exponent - SIGNIFICANT_BITS) + 0.0


class _Best:
    """The running best k of each query of one block; free places have the key minus infinity."""

    def __init__(self, queries, k, decimals, floor=None):
        self.k = k
        # Scores below this are known not to be among the best.
        self.floor = _EMPTY if floor is None else floor
        self.decimals = decimals
        self.key = np.full((queries, k), _EMPTY)
        self.item = np.full((queries, k), _NO_ID)
        self.score = np.full((queries, k), _EMPTY)
        self.ref = np.full((queries, k), -1)

    def merge(self, score, item, ref):
        """Take in scores (queries x items) of items in ascending id order; minus infinity is no candidate."""
        key = rank_key(score, self.decimals)
        count = key.shape[1]
        if count > self.k:
            least = np.partition(key, count - self.k, axis=1)[:, [count - self.k]]
            above, equal = key > least, key == least
            room = self.k - above.sum(axis=1, keepdims=True)
            taken = above | (equal & (np.cumsum(equal, axis=1) <= room))
            pick = np.nonzero(taken)[1].reshape(len(key), self.k)
        else:
            pick = np.broadcast_to(np.arange(count), key.shape)
        key = np.hstack([self.key, np.take_along_axis(key, pick, 1)])
        item = np.hstack([self.item, item[pick]])
        score = np.hstack([self.score, np.take_along_axis(score, pick, 1)])
        ref = np.hstack([self.ref, ref[pick]])
        order = np.lexsort((item, -key), axis=1)[:, : self.k]
        self.key = np.take_along_axis(key, order, 1)
        self.item = np.take_along_axis(item, order, 1)
        self.score = np.take_along_axis(score, order, 1)
        self.ref = np.where(self.key == _EMPTY, -1, np.take_along_axis(ref, order, 1))


    def take(self, query, score, item, ref):
        """Take in the scores of some (query, item) pairs, a query's in ascending id order."""
        key = rank_key(score, self.decimals)
        least, last = self.key[query, -1], self.item[query, -1]
        better = (key > least) | ((key == least) & (item < last))
        if not better.any():
            return
        query, key, item, score, ref = (x[better] for x in (query, key, item, score, ref))
        here = np.unique(query)
        old = np.repeat(here, self.k)
        query = np.concatenate([old, query])
        columns = [np.concatenate([x[here].ravel(), y]) for x, y in ((self.key, key), (self.item, item), (self.score, score), (self.ref, ref))]
        order = np.lexsort((columns[1], -columns[0], query))
        # The first k of each query; it has k places at least.
        first = np.searchsorted(query[order], here)
        order = order[(first[:, None] + np.arange(self.k)).ravel()]
        for mine, column in zip((self.key, self.item, self.score, self.ref), columns, strict=True):
            mine[here] = column[order].reshape(-1, self.k)
        self.ref[self.key == _EMPTY] = -1

    def bound(self):
        """What a score must reach at least to be among the best k; minus infinity where there aren't k yet."""
        key = self.key[:, -1]
        slack = 0.51 * 10.0**-self.decimals if self.decimals is not None else 0.0
        return np.maximum(self.floor, np.where(key == _EMPTY, _EMPTY, key - (np.abs(key) * 2.0 ** (2 - SIGNIFICANT_BITS) + slack)))


class Scorer:
    """Best items of every block over the batches given to ``add``.

    A block may hold ``allowed`` (queries x cells); then items have a ``cell``, and
    a query meets the items of its cells. It may hold a ``floor`` for each score.
    """

    @classmethod
    def of(cls, table, k, metric, payload, decimals=None, size=_BLOCK_QUERIES):
        """For a table of queries."""
        return cls(query_blocks(table, size), _plain(table.column("query_id")), k, metric, payload, decimals)

    def __init__(self, blocks, query_ids, k, metric, payload, decimals=None):
        self.blocks = blocks
        self.query_ids = query_ids
        self.best = [_Best(len(b["rows"]), k, decimals, b.get("floor")) for b in blocks]
        self.metric = metric
        self.payload = list(payload)
        self.kept = None
        self.centre, self.rough = None, [None] * len(blocks)
        if blocks and "matrix" in blocks[0]:
            if metric == "l2":
                self.centre = sum(b["matrix"].sum(axis=0) for b in blocks) / sum(len(b["matrix"]) for b in blocks)
                self.centre = self.centre if np.isfinite(self.centre).all() else None
            self.rough = [_Rough(b["matrix"], metric, self.centre) for b in blocks]

    def _few(self, vectors, rows, block, best, asked, given, at, allowed):
        """(query, place in rows) of all pairs that may be among the best k, or nothing where these are too many.

        ``asked`` and ``given`` are the block and all items in single precision, ``at`` the chunk's place there.
        """
        items = given.rows[at : at + len(rows)]
        width = items.shape[1]
        error = (width + 8) * 2.0**-24
        if self.metric == "l2":
            ratio = given.top / asked.top
            asked.rows[:, -1] = ratio
            error = error * (1 + ratio / 2) + width * 2.0**-50 * (ratio + 1 / ratio)
            scale = 2 * asked.top * given.top
        elif self.metric == "dot":
            scale = asked.top * given.top
        else:
            scale = 1.0
        if not (np.isfinite(error) and 1e-250 < scale < 1e250):
            return None
        rough = asked.rows @ items.T
        need = best.bound()
        if self.metric == "l2":
            need = need + asked.square
        need = need / scale - error
        if allowed is not None and (need == _EMPTY).any():
            # Other pairs give no bound; without one they are left out here.
            rough[~allowed()] = _EMPTY
            need = np.maximum(need, -1e38)
        if len(rows) > best.k and (need <= -1e38).any():
            # Rough scores of k items here are above this, and ties by rounding are below it at most by so much.
            least = np.partition(rough, len(rows) - best.k, axis=1)[:, len(rows) - best.k].astype(float)
            slack = 2.0**-36 + (0.0 if best.decimals is None else 1.02 * 10.0**-best.decimals / scale)
            need = np.maximum(need, least - 2 * error - slack)
        need = np.nextafter(need.astype(np.float32), np.float32(-np.inf))
        found = np.flatnonzero(rough >= need[:, None])
        return np.divmod(found, len(rows)) if len(found) <= rough.size * _FEW else None

    def _exact(self, vectors, rows, block, query, place, square):
        """Scores in double precision of some pairs; ``square`` are the items' squared lengths."""
        score, step = np.empty(len(query)), max(1, _CHUNK_PRODUCTS // max(1, block["matrix"].shape[1]))
        for at in range(0, len(query), step):
            q, i = query[at : at + step], place[at : at + step]
            one, other = block["matrix"][q], vectors.values[rows[i]]
            if self.metric == "l2":
                score[at : at + step] = -_squares(one - other)
                continue
            product = np.einsum("ij,ij->i", one, other)
            if self.metric == "cosine":
                norm = np.sqrt(block["square"][q]) * np.sqrt(square[i])
                product = product / np.where(norm == 0, 1.0, norm)
            score[at : at + step] = product
        if not np.isfinite(score).all():
            raise ValueError("vectors must give finite scores")
        return score

    def _merge(self, vectors, rows, block, best, asked, given, at, ids, base, cells):
        """Take in one chunk of items."""
        allowed = None if cells is None else lambda: block["allowed"][:, cells[rows]]
        if given is not None and given.safe and asked.safe:
            few = self._few(vectors, rows, block, best, asked, given, at, allowed)
            if few is not None:
                query, place = few
                if cells is not None:
                    met = block["allowed"][query, cells[rows[place]]]
                    query, place = query[met], place[met]
                best.take(query, self._exact(vectors, rows, block, query, place, given.square[at:]), ids[rows[place]], rows[place] + base)
                return
        score = self._score(vectors, rows, block, best, allowed)
        if given is None:
            found = np.flatnonzero(score >= best.bound()[:, None])
            if len(found) <= score.size * _FEW:
                query, place = np.divmod(found, len(rows))
                best.take(query, score[query, place], ids[rows[place]], rows[place] + base)
                return
        best.merge(score, ids[rows], rows + base)

    def _score(self, vectors, rows, block, best, allowed=None):
        product = vectors.products(rows, block)
        if self.metric == "l2":
            score = self._minus_distances(vectors, rows, block, best, product, allowed)
        elif self.metric == "dot":
            score = product
        else:
            norm = np.sqrt(block["square"])[:, None] * np.sqrt(vectors.squares(rows))
            score = product / np.where(norm == 0, 1.0, norm)
        if not (np.isfinite(score) | (score == _EMPTY)).all():
            raise ValueError("vectors must give finite scores")
        return score

    def _minus_distances(self, vectors, rows, block, best, product, allowed):
        """Squared distances of all that may be among the best k, from differences; others are no candidates.

        The product form gives each distance up to a bound of its error; what is
        farther than the k-th by more than both bounds can't win.
        """
        if "matrix" not in block:
            raise ValueError("l2 needs dense vectors")
        square = block["square"][:, None] + vectors.squares(rows)
        if not np.isfinite(square).all():
            raise ValueError("vectors must give finite scores")
        error = square * (4 * (block["matrix"].shape[1] + 4) * np.finfo(float).eps)
        rough = square - 2.0 * product
        if allowed is not None:
            rough[~allowed()] = np.inf
        worst = rough + error
        k = best.k
        limit = np.partition(worst, k - 1, axis=1)[:, k - 1] if worst.shape[1] > k else np.full(len(worst), np.inf)
        limit = np.minimum(limit, np.where(best.key[:, -1] == _EMPTY, np.inf, -best.score[:, -1]))
        # Room for what only rounding sets apart.
        limit = limit * (1 + 1e-9) + (0.0 if best.decimals is None else 10.0**-best.decimals)
        query, item = np.nonzero((rough - error <= limit[:, None]) & (rough < np.inf))
        score = np.full(rough.shape, _EMPTY)
        step = max(1, _CHUNK_PRODUCTS // max(1, block["matrix"].shape[1]))
        for at in range(0, len(query), step):
            q, i = query[at : at + step], item[at : at + step]
            apart = block["matrix"][q] - vectors.values[rows[i]]
            score[q, i] = -np.einsum("ij,ij->i", apart, apart)
        return score

    def add(self, batch):
        if not batch.num_rows:
            return
        ids = batch.column("item_id").to_numpy(zero_copy_only=False)
        by_id = np.argsort(ids, kind="stable")
        vectors = _vectors(batch)
        kinds = None
        if "kind" in batch.schema.names:
            kinds = np.asarray(batch.column("kind").to_pylist(), dtype=object)
        own = pa.table({c: _plain(batch.column(c)) for c in self.payload}) if self.payload else None
        base = 0 if self.kept is None else self.kept.num_rows
        parts, cells = {}, batch.column("cell").to_numpy(zero_copy_only=False) if "cell" in batch.schema.names else None
        for block, best, asked in zip(self.blocks, self.best, self.rough):
            if block["kind"] not in parts:
                rows = by_id if block["kind"] is None else by_id[kinds[by_id] == block["kind"]]
                given = None if asked is None else _Rough(vectors.values[rows], self.metric, self.centre)
                parts[block["kind"]] = rows, given
            rows, given = parts[block["kind"]]
            if cells is not None:
                met = block["allowed"].any(axis=0)[cells[rows]]
                if not met.all():
                    rows, given = rows[met], given.only(met)
            at = 0
            for chunk in vectors.chunks(rows, block):
                self._merge(vectors, chunk, block, best, asked, given, at, ids, base, cells)
                at += len(chunk)
        if own is not None:
            self._compact(own)

    def _compact(self, own):
        """Keep only the payload rows that some query still refers to."""
        full = own if self.kept is None else pa.concat_tables([self.kept, own])
        used = np.unique(np.concatenate([b.ref[b.ref >= 0] for b in self.best] or [np.empty(0, int)]))
        self.kept = full.take(pa.array(used))
        for best in self.best:
            live = best.ref >= 0
            best.ref[live] = np.searchsorted(used, best.ref[live])

    def result(self):
        """One Arrow table of winners per block."""
        for block, best in zip(self.blocks, self.best):
            query, place = np.nonzero(best.key > _EMPTY)
            columns = {
                "query_id": self.query_ids.take(pa.array(block["rows"][query])),
                "item_id": pa.array(best.item[query, place]),
                "score": pa.array(best.score[query, place]),
                "score_key": pa.array(best.key[query, place]),
            }
            if self.kept is not None:
                refs = pa.array(best.ref[query, place])
                for c in self.payload:
                    columns[c] = self.kept.column(c).take(refs).combine_chunks()
            yield pa.table(columns)


def _vector_columns(df: DataFrame) -> list[str]:
    return ["vector"] if "vector" in df.columns else ["indices", "weights"]


def _with_vector(df: DataFrame) -> DataFrame:
    # Sparse vectors are computed and never null; a filter on them would be
    # pushed below and compute them a second time.
    return df.where(F.col("vector").isNotNull()) if "vector" in df.columns else df


def _item_side(items: DataFrame, payload) -> DataFrame:
    names = items.columns
    vector = _vector_columns(items)
    items = _with_vector(items)
    columns = ["item_id", *vector, *payload]
    if "item_type" in names:
        return items.select(*columns, F.lower("item_type").alias("kind"))
    return items.select(*columns)


def _query_side(queries: DataFrame) -> DataFrame:
    names = queries.columns
    vector = _vector_columns(queries)
    queries = _with_vector(queries)
    wanted = F.lit(None).cast("string")
    if "query_type" in names:
        wanted = F.when(~no_type_filter(F.col("query_type")), F.lower("query_type"))
    return queries.select("query_id", *vector, wanted.alias("wanted"))


def winners(items: DataFrame, queries: DataFrame, payload) -> T.StructType:
    """The schema of what tasks return."""
    found = [T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("score_key", T.DoubleType())]
    return T.StructType([queries.schema["query_id"], *found, *(items.schema[c] for c in payload)])


def nearest(
    items: DataFrame,
    queries: DataFrame,
    k: int,
    metric: str = "cosine",
    payload: Sequence[str] = (),
    decimals: int | None = None,
    block_rows: int = BLOCK_ROWS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Rank the k best items of each query: (query_id, item_id, score, rank, payload).

    ``items``: item_id and a vector, item_type where a query may ask for one.
    ``queries``: query_id and a vector, query_type optional; the type filter
    applies before the cut. ``metric``: cosine, dot, or l2 (score is minus the
    squared distance, computed from differences). Every item is a candidate, one
    scoring zero included. Scores rank as they are, to twelve significant digits,
    or rounded to ``decimals``. Of ``block_rows`` queries, or 4,096 if it is more,
    all are broadcast; so many are scored at a time, while ``block_bytes`` bounds
    the queries that a task holds.
    """
    if metric not in ("cosine", "dot", "l2"):
        raise ValueError(f"unknown metric {metric!r}")
    if k < 1:
        raise ValueError("k must be at least 1")
    payload = list(payload)
    typed = "query_type" in queries.columns
    if typed and "item_type" not in items.columns:
        raise ValueError("a type filter needs items with item_type")
    left = _item_side(items, payload)
    right = _query_side(queries)
    schema = winners(left, right, payload)
    head = _small_table(right, block_rows, block_bytes)
    if head is not None:
        found = _by_broadcast(left, head, k, metric, payload, schema, decimals, min(_BLOCK_QUERIES, block_rows))
    else:
        found = _by_grid(left, right, k, metric, payload, schema, decimals, block_rows, block_bytes)
    best = [F.col("score_key").desc(), F.col("item_id").asc()]
    # Every task holds rows of every query, so the last step is narrowed twice.
    ranked = top_rows(found, ["query_id"], best, k, salts=wide_salts(found))
    return ranked.drop("score_key")


def extent(queries: DataFrame) -> DataFrame:
    """(rows, about how many bytes) of a query table."""
    vector = F.size("vector") * 4 if "vector" in queries.columns else F.size("indices") * 12
    return queries.agg(F.count("*"), F.coalesce(F.sum(vector.cast("long") + 32), F.lit(0)))


def _small_table(queries: DataFrame, rows: int, size: int):
    """The query table, if it is within one block's bounds; nothing of a larger one reaches the driver."""
    look = min(rows, 4096)
    found, total = extent(queries.limit(look + 1)).first()
    return queries.toArrow() if found <= look and total <= size else None


def _by_grid(items, queries, k, metric, payload, schema, decimals, rows, size):
    """Every stack of blocks of queries meets every slice of the items in a task of its own.

    Queries are copied once per slice and items once per stack, not per block. A
    stack holds ``STACK_ROWS`` queries or, where these would be more stacks than
    balance both kinds of copies, more of them, within the bounds of a task; there
    are only as many slices as give every task of a shuffle work.
    """
    shared_folder(queries.sparkSession)
    queries = queries.checkpoint()
    n, total = extent(queries).first()
    width = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stacks = max(stacks_of(n, width), -(-total // size))
    slices = max(1, -(-width // stacks))
    asked = queries.select(
        F.pmod(F.xxhash64("query_id"), F.lit(stacks)).cast("int").alias("stack"), each(slices).alias("slice"), F.struct("*").alias("query")
    )
    given = items.select(
        each(stacks).alias("stack"), F.pmod(F.xxhash64("item_id"), F.lit(slices)).cast("int").alias("slice"), F.struct("*").alias("item")
    )
    block = min(_BLOCK_QUERIES, rows)
    return score_cells(asked, given, ["stack", "slice"], schema, lambda table: Scorer.of(table, k, metric, payload, decimals, block))


def stacks_of(n: int, width: int, most: int = BLOCK_ROWS) -> int:
    """How many tasks share ``n`` queries, in a shuffle of ``width`` partitions: none holds over ``most``."""
    return max(1, -(-n // most), min(-(-n // STACK_ROWS), math.isqrt(3 * width) + 1))


def each(n: int):
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def score_cells(asked, given, cell, schema, scorer_of):
    """Winners of the queries (cell, query) among the items (cell, item) of the same cell.

    A task holds the queries of one cell, which come first, and streams its items
    past them: ``scorer_of(query table)`` takes batches of items by ``add`` and
    gives tables of ``schema`` by ``result``.
    """
    asked = asked.select(*cell, "query", F.lit(None).cast(given.schema["item"].dataType).alias("item"))
    given = given.select(*cell, F.lit(None).cast(asked.schema["query"].dataType).alias("query"), "item")
    met = asked.unionByName(given).repartition(*cell).sortWithinPartitions(*cell, F.col("query").isNull())

    def rows_of(column):
        return pa.RecordBatch.from_arrays(column.flatten(), [f.name for f in column.type])

    def score(batches):
        at, held, scorer = None, [], None
        for batch in batches:
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in cell]
            is_item = pc.is_valid(batch.column("item")).to_numpy(zero_copy_only=False)
            new = np.any([x[1:] != x[:-1] for x in (*keys, is_item)], axis=0) if batch.num_rows > 1 else np.empty(0, bool)
            bounds = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for begin, end in zip(bounds, bounds[1:]):
                here = tuple(x[begin] for x in keys)
                if here != at:
                    if scorer is not None:
                        yield from (b for table in scorer.result() for b in table.to_batches())
                    at, held, scorer = here, [], None
                part = batch.slice(begin, end - begin)
                if not is_item[begin]:
                    held.append(rows_of(part.column("query")))
                elif held:
                    if scorer is None:
                        scorer = scorer_of(pa.Table.from_batches(held))
                    scorer.add(rows_of(part.column("item")))
        if scorer is not None:
            yield from (b for table in scorer.result() for b in table.to_batches())

    return met.mapInArrow(score, schema)


def _by_broadcast(items, head, k, metric, payload, schema, decimals, size):
    spark = items.sparkSession
    shared = spark.sparkContext.broadcast(
        {"blocks": query_blocks(head, size), "ids": _plain(head.column("query_id"))}
    )

    def score(batches):
        scorer = Scorer(shared.value["blocks"], shared.value["ids"], k, metric, payload, decimals)
        for batch in batches:
            scorer.add(batch)
        for table in scorer.result():
            yield from table.to_batches()

    return items.mapInArrow(score, schema)
