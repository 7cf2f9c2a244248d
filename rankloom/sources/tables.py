"""Sources and sinks of catalogs, vectors, truth sets and run configs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom import schemas

# Texts read as null in every CSV column (fixed values).
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
_COLUMNS = {
    schemas.NAME: "name",
    schemas.DESCRIPTION: "description",
    schemas.URL: "url",
    schemas.EMBEDDING_TEXT: "embedding_text",
    schemas.ITEM_TYPE: "item_type",
}


def nulls_from_tokens(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            F.when(~F.col(f"`{f.name}`").isin(NA_TOKENS), F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


# How line breaks are written in a CSV of one line per row (the backslash itself first).
_BREAKS = [("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")]
_HELD = "\x00"


def _on_one_line(text):
    for plain, written in _BREAKS:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def _with_breaks(text):
    text = F.replace(text, F.lit(_BREAKS[0][1]), F.lit(_HELD))
    for plain, written in _BREAKS[1:]:
        text = F.replace(text, F.lit(written), F.lit(plain))
    return F.replace(text, F.lit(_HELD), F.lit(_BREAKS[0][0]))


def _csv(spark: SparkSession, path: str, schema: T.StructType, one_line: bool) -> DataFrame:
    reader = spark.read.schema(schema).option("header", True).option("multiLine", not one_line).option("escape", '"')
    return reader.csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, one_line: bool = False) -> DataFrame:
    """Headered CSV; null tokens become nulls.

    Line breaks in quotes make a file one task. With ``one_line`` rows hold none
    (see :func:`write_catalog`), and large files are split.
    """
    rows = _csv(spark, path, schema, one_line)
    if one_line:
        rows = rows.select(*[_with_breaks(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in schema])
    return nulls_from_tokens(rows)


def read_catalog(
    spark: SparkSession, path: str, schema: T.StructType = schemas.CATALOG_RAW, one_line: bool = False
) -> DataFrame:
    """A catalog CSV under plain column names, with ``seq`` in file order.

    ``seq`` orders by file, then block, then row: ``monotonically_increasing_id``
    alone follows the split order, which is by size.
    """
    texts = {c: F.col(f"`{c}`") for c in schema.names}
    rows = _csv(spark, path, schema, one_line).select(
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("seq"),
        *[(_with_breaks(x) if one_line else x).alias(_COLUMNS[c]) for c, x in texts.items()],
    )
    return nulls_from_tokens(rows)


def with_item_ids(df: DataFrame) -> DataFrame:
    """Unique ids; write the result before using it, as a rerun may number anew."""
    return df.withColumn("item_id", F.monotonically_increasing_id())


def write_catalog(df: DataFrame, path: str, one_line: bool = False) -> None:
    """The catalog as headered CSV under its file column names.

    ``one_line`` writes line breaks as ``\\n``, so the files can be split when read.
    """
    named = [
        (_on_one_line(F.col(plain)) if one_line else F.col(plain)).alias(header)
        for header, plain in _COLUMNS.items()
        if plain in df.columns
    ]
    writer = df.select(*named).write.mode("overwrite").option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(query, url) truth rows."""
    rows = read_csv(spark, path, schemas.TRUTH)
    return rows.select(F.col("Query").alias("query"), F.col("Assessment_url").alias("url"))


def write_vectors(df: DataFrame, path: str) -> None:
    """Vectors and their metadata side by side, keyed by item_id."""
    df.write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def items_from_lists(lists: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """Rows from metadata stored as parallel lists, numbered by position."""
    rows = lists.select(*keep, F.posexplode(F.arrays_zip(*columns)).alias("item_id", "row"))
    return rows.select(*keep, F.col("item_id").cast("long"), *[F.col("row")[c].alias(c) for c in columns])


def write_run_config(config: DataFrame, path: str) -> None:
    config.coalesce(1).write.mode("overwrite").json(path)


def read_run_config(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RUN_CONFIG).option("multiLine", True).json(path)
