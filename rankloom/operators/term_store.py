"""Term counts stored by batch: a vocabulary is refitted without reading old texts again.

Counts add up, so every batch of texts is counted once and stored as (term, total,
df), the most frequent first. A fit finds the most frequent terms of all batches in
three steps. The best terms of each batch, added up, give a bound that the wanted
terms reach; a term that reaches it in all has at least the bound over the number of
batches in one of them; only the counts of these candidates are added up in full.
The result is that of a fit on all texts at once.

Defined results: a batch written again under its number replaces itself, and counts
once its size is written, which is the last step. Texts without words count as texts.
Sizes, one row a batch, are read on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.operators.rank import top_rows
from rankloom.operators.tfidf import MAX_FEATURES, TfidfIndex, term_counts
from rankloom.session import materialise

# Candidates are sent to the tasks up to this size in bytes, and joined beyond it.
SENT = 64 << 20
# Characters whose terms one task combines before the shuffle, in memory.
TASK_CHARS = 16 << 20


@dataclass(frozen=True)
class TermStore:
    spark: SparkSession
    path: str

    def add(self, corpus: DataFrame, text: str, number: int) -> None:
        """Count the words and word pairs of a batch of texts."""
        size = materialise(corpus.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.length(text).cast("long")), F.lit(0)).alias("chars")))
        # However the texts lie in files, a task holds the different terms of a few.
        dealt = corpus.select(text).repartition(max(-(-size.first()["chars"] // TASK_CHARS), corpus.sparkSession.sparkContext.defaultParallelism))
        counted = term_counts(dealt, text).sortWithinPartitions(F.col("total").desc())
        counted.write.mode("overwrite").parquet(f"{self.path}/counts/batch={number}")
        size.select("n_rows").write.mode("overwrite").parquet(f"{self.path}/sizes/batch={number}")

    def sizes(self) -> dict[int, int]:
        """Rows of every stored batch."""
        found = self.spark.read.schema("n_rows long, batch int").parquet(f"{self.path}/sizes").collect()
        return {r.batch: r.n_rows for r in found}

    def counts(self) -> DataFrame:
        """(term, total, df, batch) of all whole batches."""
        stored = self.spark.read.schema("term string, total long, df long, batch int").parquet(f"{self.path}/counts")
        return stored.where(F.col("batch").isin(list(self.sizes())))

    def candidates(self, max_features: int = MAX_FEATURES) -> DataFrame:
        """Terms that may be among the ``max_features`` most frequent; none of these is missing."""
        counts, batches = self.counts(), len(self.sizes())
        # What is below the total of a batch's last wanted term isn't sorted; there are few different totals.
        totals = counts.groupBy("batch", "total").agg(F.count(F.lit(1)).alias("n"))
        more = F.sum("n").over(Window.partitionBy("batch").orderBy(F.col("total").desc())) - F.col("n")
        last = totals.withColumn("more", more).where(F.col("more") < max_features).groupBy("batch").agg(F.min("total").alias("last"))
        high = counts.join(F.broadcast(last), "batch").where(F.col("total") >= F.col("last")).drop("last")
        best = top_rows(high, ["batch"], [F.col("total").desc(), F.col("term")], max_features)
        added = best.groupBy("term").agg(F.sum("total").alias("total")).orderBy(F.col("total").desc()).limit(max_features)
        least, number = added.agg(F.min("total"), F.count(F.lit(1))).first()
        reached = counts if number < max_features else counts.where(F.col("total") * batches >= least)
        return reached.select("term").distinct()

    def fit(self, max_features: int = MAX_FEATURES) -> TfidfIndex:
        """The vocabulary of all batches; at most ``max_features`` rows reach the driver."""
        wanted = materialise(self.candidates(max_features))
        size = wanted.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
        wanted = F.broadcast(wanted) if size <= SENT else wanted
        added = self.counts().join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))
        table = added.orderBy(F.col("total").desc(), "term").limit(max_features).toArrow()
        if not table.num_rows:
            raise ValueError("empty vocabulary: no text holds a word")
        return TfidfIndex(*(table.column(c).to_pylist() for c in ("term", "total", "df")), sum(self.sizes().values()))
