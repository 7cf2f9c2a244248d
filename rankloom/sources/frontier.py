"""Links seen by earlier crawls, stored by bucket, so that a crawl shuffles its own links only.

Defined results: a link counts as new in the first crawl that shows it. A crawl written
again under its number gives the same links and is stored once. Null links are not links.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.pages import first_pages
from rankloom.session import materialise


@dataclass(frozen=True)
class SeenLinks:
    """A table of the session's catalog over the files at ``path``; crawls are numbered in order."""

    spark: SparkSession
    path: str
    table: str
    buckets: int = 64

    def stored(self) -> DataFrame:
        """(link, first_page, crawl) of all links seen."""
        if not self.spark.catalog.tableExists(self.table):
            self.spark.sql(
                f"create table {self.table} (link string, first_page bigint, crawl int) using parquet "
                f"clustered by (link) sorted by (link) into {self.buckets} buckets location '{self.path}'"
            )
        return self.spark.table(self.table)

    def new(self, links: DataFrame, crawl: int) -> DataFrame:
        """(link, first_page) of a crawl's links (page_id, link) that no crawl before has shown.

        The stored side is read by bucket and not shuffled; repeats of a link are combined before the shuffle.
        """
        seen = self.stored().where(F.col("crawl") < crawl).select("link")
        return first_pages(links.where("link is not null")).join(seen, "link", "left_anti")

    def add(self, links: DataFrame, crawl: int) -> DataFrame:
        """The new links, written first, then stored; a crawl that is stored already is not stored again."""
        found = materialise(self.new(links, crawl))
        if self.stored().where(F.col("crawl") == crawl).isEmpty():
            rows = found.select("link", F.col("first_page").cast("long").alias("first_page"), F.lit(crawl).alias("crawl"))
            # A task a bucket, so that a crawl adds one file to each.
            dealt = rows.repartition(self.buckets, "link")
            dealt.write.mode("append").format("parquet").bucketBy(self.buckets, "link").sortBy("link").saveAsTable(self.table)
        return found
