"""Titles and names of which one holds the other, over a whole catalog, by an index of short pieces.

A text can only be held by another that has all its pieces of ``q`` characters, so a
text looks for its rarest piece alone and the few texts with that are compared in full.
Texts shorter than ``q`` are a piece themselves. Both directions are looked for.
Texts are compared in lower case; equal ones are compared once, and pieces travel with
a digest instead of their text.

Defined results: null and empty texts match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.session import materialise

# A piece's texts are spread over so many parts of the join.
PARTS = 16


def _pieces(chars: Column, sizes: list[int]) -> Column:
    """Different pieces of ``sizes`` characters of a text that is split already, as that is not to be done for every piece."""

    def of(size: int) -> Column:
        last = F.size(chars) - size
        return F.when(
            last >= 0,
            F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.concat(*[F.get(chars, i + k) for k in range(size)])),
        ).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*map(of, sizes)))


def _keyed(texts: DataFrame, column: str) -> DataFrame:
    """(key, text): the different texts in lower case."""
    lower = texts.select(F.lower(column).alias("text")).where("text <> ''").distinct()
    return lower.select(F.md5("text").alias("key"), "text")


def _held(short: DataFrame, long: DataFrame, q: int) -> DataFrame:
    """(short, long): texts of ``short`` that are part of one of ``long``; both are (key, text)."""
    size = F.length("text")
    own = F.when(size >= q, _pieces(F.col("chars"), [q])).otherwise(F.array("text"))
    looked = short.withColumn("chars", F.split("text", "")).select("key", F.explode(own).alias("piece"))
    split = long.withColumn("chars", F.split("text", ""))
    there = split.select(F.col("key").alias("long_key"), F.explode(_pieces(F.col("chars"), list(range(1, q + 1)))).alias("piece"))
    there = materialise(there.join(looked.select("piece").distinct(), "piece", "left_semi"))
    often = there.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    rated = looked.join(often, "piece", "left")
    # A text with a piece that nothing has is held by nothing.
    rarest = rated.groupBy("key").agg(F.min(F.struct("n", "piece")).alias("least"), F.count("n").alias("found"), F.count(F.lit(1)).alias("all"))
    rarest = rarest.where("found = all").select("key", F.col("least.piece").alias("piece"))
    spread = rarest.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    met = there.withColumn("part", F.pmod(F.xxhash64("long_key"), F.lit(PARTS))).join(spread, ["piece", "part"]).select("key", "long_key")
    texts = met.join(short.withColumnRenamed("text", "short"), "key").join(long.select(F.col("key").alias("long_key"), F.col("text").alias("long")), "long_key")
    return texts.where(F.contains("long", "short")).select("short", "long")


def containments(titles: DataFrame, names: DataFrame, title: str = "title", name: str = "name", q: int = 3) -> DataFrame:
    """(title, name): all pairs of different texts, in lower case, of which one holds the other."""
    asked, known = materialise(_keyed(titles, title)), materialise(_keyed(names, name))
    within = _held(asked, known, q).select(F.col("short").alias("title"), F.col("long").alias("name"))
    around = _held(known, asked, q).select(F.col("long").alias("title"), F.col("short").alias("name"))
    return within.unionByName(around.where("title <> name"))


def items_of_titles(titles: DataFrame, items: DataFrame, q: int = 3) -> DataFrame:
    """(title, n_items, first_item): how many items match a title, and the smallest id of them.

    ``titles`` hold title, ``items`` item_id and name. Items of one name are counted before the join.
    """
    named = items.groupBy(F.lower("name").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("first"))
    met = containments(titles, items, q=q).join(named, "name")
    return met.groupBy("title").agg(F.sum("n").alias("n_items"), F.min("first").alias("first_item"))
