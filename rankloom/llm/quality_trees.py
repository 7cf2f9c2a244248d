"""A quality classifier: gradient-boosted trees on histograms of document statistics.

Statistics of whole texts are computed where the texts lie. The trees are fitted
to a bounded sample of labelled rows (``max_rows``, those of the smallest hash of
their id), whose statistics alone reach the driver, and are kept as flat arrays:
complete trees of one depth, in which a row's way is found by indexing, for all
rows of a batch at once.

Defined results: a null text counts as empty; an empty one has zero statistics
and a score like any other text. Labels that are null are not used; without any
label every score is 0.5. Repeated rows have equal scores, and as often labelled
rows count as often. Other columns are passed on, but for ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm.batches import short

_BYTES = np.arange(256)
_KINDS = np.stack([
    (_BYTES >= 97) & (_BYTES <= 122),
    (_BYTES >= 65) & (_BYTES <= 90),
    (_BYTES >= 48) & (_BYTES <= 57),
    np.isin(_BYTES, list(b"#*$%&|<>")),
    np.isin(_BYTES, list(b".,;:'\"()-?")),
    _BYTES == 33,
    _BYTES == 10,
    np.isin(_BYTES, list(b" \t\x0b\x0c\r")),
    _BYTES >= 128,
], axis=1).astype(np.float64)
N_STATISTICS = _KINDS.shape[1] + 8


def statistics(texts: list[bytes | None]) -> np.ndarray:
    """One row of document statistics per text."""
    out = np.zeros((len(texts), N_STATISTICS))
    for row, text in zip(out, texts, strict=True):
        if not text:
            continue
        words, lines = text.split(), text.split(b"\n")
        n = max(1, len(words))
        row[: _KINDS.shape[1]] = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _KINDS / len(text)
        row[_KINDS.shape[1] :] = (
            np.log1p(len(text)),
            np.log1p(len(words)),
            len(text) / n,
            len(set(words)) / n,
            (1 + len(set(zip(words, words[1:], strict=False)))) / n,
            max(map(len, words), default=0),
            len(set(lines)) / len(lines),
            len(text) / len(lines),
        )
    return out


@dataclass
class Forest:
    """Complete binary trees: ``feature`` and ``cut`` by tree and inner node, ``leaf`` by tree and leaf."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while node.size and node[0] < len(feature):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - len(feature)] if node.size else 0.0
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2, ridge: float = 1.0) -> Forest:
    """Boosting with the logistic loss; splits are sought on histograms of gradients over quantile bins."""
    inner = 2**depth - 1
    if not len(y):
        return Forest(0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], axis=0).T
    binned = np.stack([np.searchsorted(e, column, "left") for e, column in zip(edges, x.T, strict=True)], axis=1)
    rate_of_ones = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    total, n_features = np.full(len(y), base), x.shape[1]
    forest = Forest(base, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    for tree in range(trees):
        p = 1 / (1 + np.exp(-total))
        gradient, weight, node = y - p, p * (1 - p), np.zeros(len(y), np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            slot = (node - first)[:, None] * n_features * bins + np.arange(n_features) * bins + binned
            g, h = (np.bincount(slot.ravel(), np.repeat(v, n_features), width * n_features * bins).reshape(width, n_features, bins).cumsum(2) for v in (gradient, weight))
            all_g, all_h = g[:, :1, -1:], h[:, :1, -1:]
            worth = lambda a, b: a * a / (b + ridge)
            gain = (worth(g, h) + worth(all_g - g, all_h - h) - worth(all_g, all_h))[:, :, :-1]
            gain[(h[:, :, :-1] < 1) | ((all_h - h)[:, :, :-1] < 1)] = 0
            best = gain.reshape(width, -1).argmax(1)
            feature, place = best // (bins - 1), best % (bins - 1)
            split = gain.reshape(width, -1).max(1) > 1e-9
            here = slice(first, first + width)
            forest.feature[tree, here] = feature
            forest.cut[tree, here] = np.where(split, edges[feature, place], np.inf)
            right = x[np.arange(len(y)), forest.feature[tree][node]] > forest.cut[tree][node]
            node = 2 * node + 1 + right
        leaf = node - inner
        g, h = np.bincount(leaf, gradient, inner + 1), np.bincount(leaf, weight, inner + 1)
        forest.leaf[tree] = rate * g / (h + ridge)
        total += forest.leaf[tree][leaf]
    return forest


def _with_statistics(texts: pa.Array) -> np.ndarray:
    return statistics(texts.cast(pa.binary()).to_pylist())


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Forest:
    """Trees for ``labels`` (doc_id, label 0 or 1) of ``docs`` (doc_id, text), from at most ``max_rows`` labels."""
    asked = labels.where("doc_id is not null and label is not null").select("doc_id", F.col("label").cast("int"))
    sample = asked.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)
    # At most max_rows rows of two numbers on the broadcast side.
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            rows = pa.array(list(_with_statistics(batch.column(1))), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), rows, batch.column(2)], ["doc_id", "x", "label"])

    found = texts.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, x array<double>, label int").orderBy("doc_id", "label").limit(max_rows)
    rows = found.collect()
    x = np.array([r.x for r in rows]).reshape(-1, N_STATISTICS)
    return fit(x, np.array([r.label for r in rows], np.float64))


def score(docs: DataFrame, forest: Forest, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, how likely the text has label 1."""
    kept = [f for f in docs.schema if f.name != "score"]
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            made = pa.array(forest.score(_with_statistics(batch.column(text))))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), made], schema.names)

    return docs.mapInArrow(run, schema)


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never learnt from; a null id has no label and is not one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
