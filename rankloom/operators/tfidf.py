"""TF-IDF over words and word pairs: vocabulary, weights and retrieval.

The vocabulary is found with one aggregation over the corpus; item vectors are
then built text by text (no shuffle), as the vocabulary is bounded by
``max_features``. Texts are cut into words once, and terms counted and weighed as
numbers in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.coded import Weigher, count_terms
from rankloom.functions.tokens import spaced
from rankloom.operators.topk import nearest
from rankloom.session import materialise

MAX_FEATURES = 8000
POOL = 20


def _counts(worded: DataFrame, words: bool = True, pairs: bool = True, among: list[str] | None = None) -> DataFrame:
    """Per term of the column ``words``: occurrences (``total``) and rows holding it (``df``).

    ``words`` or ``pairs`` leave out the others. Tasks count a part of their texts
    at a time; the parts' counts are combined before the shuffle.
    """

    def count(batches):
        given = None if among is None else pa.array(among, pa.string())
        for batch in batches:
            yield from count_terms(batch.column(0), words, pairs, given)

    counted = worded.select("words").mapInArrow(count, "term string, total long, df long")
    return counted.groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))


def term_counts(corpus: DataFrame, text: str) -> DataFrame:
    """(term, total, df) of all words and word pairs of the corpus."""
    return _counts(corpus.select(spaced(F.col(text)).alias("words")))


def vocabulary(corpus: DataFrame, text: str, max_features: int = MAX_FEATURES) -> DataFrame:
    """The ``max_features`` most frequent terms, equal counts in term order.

    Words are counted first. A pair occurs no more often than its rarer word, so
    once there are enough words, only pairs of words as frequent as the last of
    them can belong; most pairs of a corpus are never made or shuffled. Where more
    than four times as many words are tied with the last, all pairs are counted.
    """
    # Written, as words and pairs are counted in two passes.
    return _frequent(materialise(corpus.select(spaced(F.col(text)).alias("words"))), max_features)


def _frequent(worded: DataFrame, max_features: int) -> DataFrame:
    """The vocabulary of the column ``words``."""
    order = [F.col("total").desc(), F.col("term")]
    single = _counts(worded, pairs=False).checkpoint()
    top = single.orderBy(*order).limit(max_features).select("term", "total", "df").toArrow()
    among = None
    if top.num_rows == max_features:
        least = top.column("total")[-1].as_py()
        frequent = single.where(F.col("total") >= least).select("term").limit(4 * max_features + 1).toArrow()
        among = frequent.column("term").to_pylist() if frequent.num_rows <= 4 * max_features else None
    paired = _counts(worded, words=False, among=among)
    # Of the words only the best max_features, already here, can belong.
    words = worded.sparkSession.createDataFrame(top, "term string, total long, df long")
    return words.unionByName(paired).orderBy(*order).limit(max_features)


@dataclass
class TfidfIndex:
    """A fitted vocabulary: terms, their counts and the number of texts."""

    terms: list[str]
    totals: list[int]
    dfs: list[int]
    n_items: int

    @classmethod
    def fit(cls, corpus: DataFrame, text: str = "text", max_features: int = MAX_FEATURES) -> TfidfIndex:
        """Fit on the whole corpus; at most ``max_features`` rows reach the driver."""
        return cls._of(vocabulary(corpus, text, max_features), corpus)

    @classmethod
    def fit_worded(cls, worded: DataFrame, max_features: int = MAX_FEATURES) -> TfidfIndex:
        """The same of a written table whose column ``words`` holds the texts' words, from ``tokens.spaced``."""
        return cls._of(_frequent(worded, max_features), worded)

    @classmethod
    def _of(cls, terms: DataFrame, corpus: DataFrame) -> TfidfIndex:
        table = terms.toArrow()
        if not table.num_rows:
            raise ValueError("empty vocabulary: no text holds a word")
        columns = [table.column(c).to_pylist() for c in ("term", "total", "df")]
        return cls(*columns, corpus.count())

    @property
    def idf(self) -> list[float]:
        """ln((1 + n) / (1 + df)) + 1 of each term."""
        return [math.log((1.0 + self.n_items) / (1.0 + df)) + 1.0 for df in self.dfs]

    def frame(self, spark: SparkSession) -> DataFrame:
        """(term_ix, term, total, df, idf)."""
        table = pa.table(
            {
                "term_ix": pa.array(range(len(self.terms)), pa.int32()),
                "term": self.terms,
                "total": self.totals,
                "df": self.dfs,
                "idf": self.idf,
            }
        )
        return spark.createDataFrame(table)

    def save(self, spark: SparkSession, path: str) -> None:
        self.frame(spark).withColumn("n_items", F.lit(self.n_items)).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TfidfIndex:
        """Read a saved vocabulary, at most ``max_features`` rows."""
        table = spark.read.parquet(path).orderBy("term_ix").toArrow()
        columns = [table.column(c).to_pylist() for c in ("term", "total", "df")]
        return cls(*columns, table.column("n_items")[0].as_py())

    def transform(self, df: DataFrame, text: str = "text") -> DataFrame:
        """Add unit-length sparse vectors as ``indices`` and ``weights``.

        Terms outside the vocabulary are dropped; a text without any known
        term gets an empty vector.
        """
        return self.transform_worded(df.withColumn("_words", spaced(F.col(text))), "_words").drop("_words")

    def transform_worded(self, df: DataFrame, words: str = "words") -> DataFrame:
        """The same for a column that holds the texts' words, from ``tokens.spaced``."""
        terms, idf = self.terms, self.idf

        @F.arrow_udf("struct<indices: array<int>, weights: array<double>>")
        def weigh(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            weigher = Weigher(terms, idf)
            for part in texts:
                yield weigher(part)

        return df.withColumn("_vector", weigh(F.col(words))).select(
            *df.columns, F.col("_vector.indices").alias("indices"), F.col("_vector.weights").alias("weights")
        )

    def weights(self, df: DataFrame, key: str, text: str = "text") -> DataFrame:
        """Postings (key, term, weight) of every text."""
        vectors = self.transform(df.select(key, text), text)
        long = vectors.select(
            key, F.inline(F.arrays_zip("indices", "weights")).alias("term_ix", "weight")
        )
        # The vocabulary holds max_features rows at most.
        terms = F.broadcast(self.frame(df.sparkSession).select("term_ix", "term"))
        return long.join(terms, "term_ix").select(key, "term", "weight")


def retrieve(
    index: TfidfIndex, items: DataFrame, queries: DataFrame, k: int = POOL, payload=(), decimals: int | None = None
) -> DataFrame:
    """The k items closest to each query text, items without a type left out.

    ``items`` hold item_id, indices, weights from :meth:`TfidfIndex.transform`
    and item_type; ``queries`` hold query_id and query. A query shares its
    candidates with every item, so short results are padded by zero scores.
    """
    vectors = index.transform(queries.select("query_id", "query"), "query")
    typed = items.where(F.col("item_type").isNotNull()) if "item_type" in items.columns else items
    return nearest(typed, vectors, k, metric="dot", payload=payload, decimals=decimals)
