"""Catalog cleaning: duplicates, nulls, texts, classes, summaries, documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions import text as tx
from rankloom.operators.rank import keep_first


def duplicates_removed(df: DataFrame, key: str) -> DataFrame:
    """Rows before and after keeping one per key (null is one key)."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count(F.lit(1)).alias("n_kept"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_removed"),
    )


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns])


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Rows need a name and a url; a missing description gets the default."""
    return df.dropna(subset=["name", "url"]).fillna({"description": tx.NO_DESCRIPTION})


def clean_texts(df: DataFrame) -> DataFrame:
    """Clean name and description and derive the embedding text."""
    cleaned = tx.with_clean_description(df.withColumn("name", tx.collapse_space(F.col("name"))))
    return cleaned.withColumn("embedding_text", tx.embedding_text(F.col("name"), F.col("description")))


def add_type(df: DataFrame, rules=tx.TYPE_RULES) -> DataFrame:
    return df.withColumn("item_type", tx.classify(F.col("name"), rules))


def clean_catalog(raw: DataFrame, order: str = "seq") -> DataFrame:
    """Raw (seq, name, description, url) to the clean catalog."""
    return add_type(clean_texts(drop_incomplete(keep_first(raw, "url", order))))


def text_lengths(df: DataFrame, column: str) -> DataFrame:
    length = F.length(column)
    return df.agg(
        F.count(F.lit(1)).alias("n_items"),
        F.avg(length).alias("avg_length"),
        F.min(length).alias("min_length"),
        F.max(length).alias("max_length"),
    )


def type_counts(df: DataFrame) -> DataFrame:
    """Rows per type, the largest first."""
    counts = df.where(F.col("item_type").isNotNull()).groupBy("item_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), "item_type")


def catalog_summary(df: DataFrame) -> DataFrame:
    """Counts by type first, so the distinct count needs no shuffle of rows."""
    def total(c):
        return F.sum(F.length(c)).alias(f"_{c}"), F.count(c).alias(f"_n_{c}")

    texts = ["name", "description", "embedding_text"]
    per_type = df.groupBy("item_type").agg(F.count(F.lit(1)).alias("n"), *[a for c in texts for a in total(c)])
    return per_type.agg(
        F.sum("n").alias("total_items"),
        F.count("item_type").alias("unique_types"),
        *[
            (F.sum(f"_{c}") / F.sum(f"_n_{c}")).alias(f"avg_{c}_length")
            for c in texts
        ],
    )


def retrieval_documents(df: DataFrame) -> DataFrame:
    """page_content with the name in front of the embedding text, and metadata."""
    return df.select(
        "item_id",
        F.concat("name", F.lit(". "), "embedding_text").alias("page_content"),
        F.struct(
            "url", "name", F.coalesce("item_type", F.lit(tx.DEFAULT_TYPE)).alias("item_type")
        ).alias("metadata"),
    )


def index_documents(df: DataFrame) -> DataFrame:
    """page_content is the embedding text alone; metadata name and url."""
    return df.select(
        "item_id", F.col("embedding_text").alias("page_content"), F.struct("name", "url").alias("metadata")
    )
