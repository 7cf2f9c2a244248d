"""A log of numbered batches with late deletes, kept as Parquet by day and bucket.

One writer numbers its batches and deletes in order, such as a stream its
micro-batches. Below a log's folder lie

* ``rows/seq=N/day=D``: an appended batch, sorted by key;
* ``deletes/seq=N``: keys cleared; this hides their rows of smaller numbers;
* ``base/gen=G/day=D/bucket=B``: compacted days, without the hidden rows;
* ``manifests/N.json``: the generation that each day is read from, and the numbers that are in it.

Readers take the newest manifest and the numbered folders that it doesn't hold.
A folder counts once it is complete, so a batch that failed half-way is not seen
and is written again under its number. ``compact`` writes only days with new or
hidden rows and then puts one new manifest in place; until that, everything is
read as before. Only ``vacuum`` deletes files, those that the newest manifest no
longer needs; readers from before the compaction must be done by then.

Defined results: a row without a key is never cleared, one without a time lies in
a day of its own. A number that is in a manifest already is not written again;
one that is smaller than the last compacted, but not in it, is an error.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NO_DAY = "__HIVE_DEFAULT_PARTITION__"
_DAY, _SEQ = T.StructField("day", T.DateType()), T.StructField("seq", T.LongType())
_GEN, _BUCKET = T.StructField("gen", T.StringType()), T.StructField("bucket", T.IntegerType())


@dataclass(frozen=True)
class Manifest:
    """``days``: the generation of every compacted day; ``spans``: the numbers in them, as ranges without gaps."""

    number: int = 0
    days: dict[str, str] = field(default_factory=dict)
    spans: list[list[int]] = field(default_factory=list)

    @property
    def last(self) -> int:
        return self.spans[-1][1] if self.spans else -1

    def holds(self, number: int) -> bool:
        return any(a <= number <= b for a, b in self.spans)

    def after(self, days: dict[str, str], numbers: list[int]) -> Manifest:
        spans = [list(s) for s in self.spans]
        for n in numbers:
            if spans and spans[-1][1] == n - 1:
                spans[-1][1] = n
            else:
                spans.append([n, n])
        return Manifest(self.number + 1, days, spans)


@dataclass(frozen=True)
class DayLog:
    """``fields`` are the stored columns, ``key`` the one that rows are found and cleared by, ``time`` gives the day."""

    spark: SparkSession
    path: str
    fields: T.StructType
    key: str
    time: str = "created_at"
    buckets: int = 64

    # --- files ---

    def _place(self, *parts: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path.rstrip("/"), *parts]))
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _names(self, *parts: str) -> list[str]:
        system, place = self._place(*parts)
        return [s.getPath().getName() for s in system.listStatus(place)] if system.exists(place) else []

    def _delete(self, *parts: str) -> None:
        system, place = self._place(*parts)
        system.delete(place, True)

    def manifest(self) -> Manifest:
        """The newest manifest: a row a day and a range of numbers, read on the driver."""
        numbers = [int(n[:-5]) for n in self._names("manifests") if n.endswith(".json") and n[:-5].isdigit()]
        if not numbers:
            return Manifest()
        system, place = self._place("manifests", f"{max(numbers)}.json")
        stream = system.open(place)
        try:
            found = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Manifest(max(numbers), found["days"], found["spans"])

    def _swap(self, manifest: Manifest) -> None:
        """Put a manifest in place, whole, by one rename."""
        system, place = self._place("manifests", f"{manifest.number}.json")
        _, draft = self._place("manifests", f"_draft-{uuid.uuid4().hex}")
        stream = system.create(draft, True)
        stream.write(bytearray(json.dumps({"days": manifest.days, "spans": manifest.spans}).encode()))
        stream.close()
        if system.exists(place) or not system.rename(draft, place):
            raise RuntimeError(f"another compaction has written {place.toString()}")

    def _numbers(self, kind: str, manifest: Manifest) -> tuple[list[int], list[int]]:
        """The numbers of complete folders that no manifest holds, and those of unfinished ones."""
        found = sorted(int(n[4:]) for n in self._names(kind) if n.startswith("seq="))
        found = [n for n in found if not manifest.holds(n)]
        done = {n for n in found if "_SUCCESS" in self._names(kind, f"seq={n}")}
        return [n for n in found if n in done], [n for n in found if n not in done]

    # --- writing ---

    def _due(self, number: int) -> bool:
        manifest = self.manifest()
        if manifest.holds(number):
            return False
        if number <= manifest.last:
            raise ValueError(f"number {number} comes after {manifest.last} was compacted")
        return True

    def append(self, rows: DataFrame, number: int) -> bool:
        """Write a batch under its number; one written again replaces itself. False if it is compacted already."""
        if not self._due(number):
            return False
        dated = rows.select(*self.fields.names).withColumn("day", F.to_date(self.time))
        # By range and not by hash of the key: rows of one busy key go to many tasks, and a task writes few folders.
        dealt = dated.repartitionByRange("day", self.key, F.xxhash64(*self.fields.names))
        dealt.sortWithinPartitions("day", self.key).write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/rows/seq={number}")
        return True

    def clear(self, keys: DataFrame, number: int) -> bool:
        """Hide all rows of smaller numbers with one of these keys."""
        if not self._due(number):
            return False
        named = keys.select(F.col(self.key)).where(F.col(self.key).isNotNull()).distinct()
        named.write.mode("overwrite").parquet(f"{self.path}/deletes/seq={number}")
        return True

    # --- reading ---

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _base(self, days: dict[str, str]) -> DataFrame:
        schema = T.StructType([*self.fields, _GEN, _DAY, _BUCKET])
        if not days:
            return self.spark.createDataFrame([], schema).drop("gen")
        paths = [f"{self.path}/base/gen={gen}/day={day}" for day, gen in sorted(days.items())]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/base").parquet(*paths).drop("gen")

    def _numbered(self, kind: str, numbers: list[int], schema: T.StructType) -> DataFrame:
        if not numbers:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/{kind}/seq={n}" for n in numbers]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*paths)

    def _fresh(self, numbers: list[int]) -> DataFrame:
        schema = T.StructType([*self.fields, _SEQ, _DAY])
        return self._numbered("rows", numbers, schema).withColumn("bucket", self._bucket())

    def _cleared(self, numbers: list[int]) -> DataFrame:
        """(key, _cleared): the last number under which a key was cleared."""
        schema = T.StructType([self.fields[self.key], _SEQ])
        return self._numbered("deletes", numbers, schema).groupBy(self.key).agg(F.max("seq").alias("_cleared"))

    def _visible(self, days: dict[str, str], rows: list[int], deletes: list[int]) -> DataFrame:
        columns = [*self.fields.names, "day", "bucket"]
        # Whatever is compacted is older than every delete that isn't.
        found = self._base(days).withColumn("seq", F.lit(-1).cast("long")).unionByName(self._fresh(rows))
        if deletes:
            # Keys only; the planner chooses the side to send by its size, and splits a busy key's rows.
            met = found.join(self._cleared(deletes), self.key, "left")
            found = met.where(F.col("_cleared").isNull() | (F.col("seq") >= F.col("_cleared")))
        return found.select(*columns)

    def read(self) -> DataFrame:
        """All rows that aren't cleared, with ``day`` and ``bucket``."""
        manifest = self.manifest()
        return self._visible(manifest.days, self._numbers("rows", manifest)[0], self._numbers("deletes", manifest)[0])

    def of_key(self, value: str) -> DataFrame:
        """The rows of one key; of compacted days only its bucket is read."""
        wanted = self.spark.range(1).select(F.lit(value).alias(self.key)).select(self._bucket()).first()[0]
        return self.read().where((F.col("bucket") == wanted) & (F.col(self.key) == value))

    # --- upkeep ---

    def compact(self) -> int:
        """Move complete batches and deletes into the base; returns how many days were written.

        It stops before the first number that is not complete. Days are listed on the driver, rows never.
        """
        manifest = self.manifest()
        (rows, open_rows), (deletes, open_deletes) = self._numbers("rows", manifest), self._numbers("deletes", manifest)
        stop = min([*open_rows, *open_deletes], default=None)
        rows, deletes = ([n for n in found if stop is None or n < stop] for found in (rows, deletes))
        if not rows and not deletes:
            return 0
        touched = {str(d) if (d := r[0]) else NO_DAY for r in self._fresh(rows).select("day").distinct().collect()}
        if deletes and manifest.days:
            hit = self._base(manifest.days).join(self._cleared(deletes), self.key, "left_semi").select("day").distinct()
            touched |= {str(d) if (d := r[0]) else NO_DAY for r in hit.collect()}
        gen = uuid.uuid4().hex
        kept = {day: old for day, old in manifest.days.items() if day not in touched}
        made = []
        if touched:
            redone = {day: old for day, old in manifest.days.items() if day in touched}
            dealt = self._visible(redone, rows, deletes).repartitionByRange("day", "bucket", self.key, F.xxhash64(*self.fields.names))
            laid = dealt.sortWithinPartitions("day", "bucket", self.key)
            laid.write.partitionBy("day", "bucket").parquet(f"{self.path}/base/gen={gen}")
            made = [n[4:] for n in self._names("base", f"gen={gen}") if n.startswith("day=")]
        self._swap(manifest.after(kept | dict.fromkeys(made, gen), sorted({*rows, *deletes})))
        return len(made)

    def vacuum(self) -> int:
        """Delete what the newest manifest doesn't need; returns how many folders and manifests went.

        Not while a compaction runs: its unfinished generation would go too.
        """
        manifest = self.manifest()
        gone = [(kind, f"seq={n}") for kind in ("rows", "deletes") for n in self._held(kind, manifest)]
        for gen in self._names("base"):
            days = [n for n in self._names("base", gen) if n.startswith("day=")]
            old = [d for d in days if manifest.days.get(d[4:]) != gen[4:]]
            gone += [("base", gen)] if len(old) == len(days) else [("base", gen, d) for d in old]
        gone += [("manifests", n) for n in self._names("manifests") if n != f"{manifest.number}.json" and not n.startswith(".")]
        for parts in gone:
            self._delete(*parts)
        return len(gone)

    def _held(self, kind: str, manifest: Manifest) -> list[int]:
        return [n for n in (int(f[4:]) for f in self._names(kind) if f.startswith("seq=")) if manifest.holds(n)]
