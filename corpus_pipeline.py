"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

Every stage works on all rows that its predecessor kept. The first four return
the columns of ``documents``; the last returns the token ids of what is left.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import bpe, quality_trees, repeats, simhash, tiling
from rankloom.session import new_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

# The trees, the repeats and the tokenizer have no counterpart in SQL.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least 0.3, by trees fitted to labels that are not held out."""
    labels = _table(spark, sf_dir, "labels").where(~quality_trees.held_out(F.col("doc_id")))
    forest = quality_trees.train(docs, labels.select("doc_id", F.col("quality").alias("label")))
    return quality_trees.score(docs, forest).where("score >= 0.3").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of fingerprints at most four bits apart: that with the smallest doc_id."""
    return simhash.keep_one(docs).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 200 bytes that also start elsewhere; halves of characters go too.

    A document of which nothing is left stays, with an empty text.
    """
    rest = repeats.without_repeats(docs, as_text=True)
    cut = F.col("n_removed") > 0
    text, size = F.when(cut, F.col("kept")).otherwise(F.col("text")), F.when(cut, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return rest.withColumns({"text": text, "n_chars": size}).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return tiling.clean(docs, _table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    vocabulary = bpe.share_vocabulary(spark, public_tokenizers.path("byte_bpe_50k.json"))
    digested = docs.select("doc_id", "text", "lang", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("_sha256"))
    both = bpe.round_trip(digested, vocabulary)
    exact = (F.sha2("decoded", 256) == F.col("_sha256")).alias("exact")
    return both.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", exact)


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", decontaminated),
    ("bpe encoding and decoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written to the shared folder and read again.

    ``session.drop_materialised`` deletes what was written.
    """
    docs = _table(spark, sf_dir, "documents")
    folder = new_folder(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{number}")
            docs = spark.read.parquet(f"{folder}/{number}")
    return docs
