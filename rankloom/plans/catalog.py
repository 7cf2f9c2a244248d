"""Building the catalog artefacts: pages, clean catalog, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.tokens import spaced
from rankloom.operators.clean import clean_catalog
from rankloom.operators.pages import catalog_rows
from rankloom.operators.tfidf import MAX_FEATURES, TfidfIndex
from rankloom.schemas import DESCRIPTION, NAME, URL
from rankloom.session import materialise


def catalog_from_pages(pages: DataFrame, site_suffix: str = "") -> DataFrame:
    """Clean catalog rows of a table of pages; the page id is the item id."""
    raw = catalog_rows(pages, site_suffix).select(
        F.col("page_id").alias("item_id"),
        F.col("page_id").alias("seq"),
        F.col(NAME).alias("name"),
        F.col(DESCRIPTION).alias("description"),
        F.col(URL).alias("url"),
    )
    return clean_catalog(raw).drop("seq")


def fit_catalog(catalog: DataFrame, max_features: int = MAX_FEATURES) -> tuple[TfidfIndex, DataFrame]:
    """The vocabulary over the whole catalog and each item with its sparse vector.

    The cleaned texts are cut into words and written once, as fitting and vectors both
    read them.
    """
    words = spaced(F.col("embedding_text")).alias("words")
    catalog = materialise(catalog.select("item_id", "name", "url", "item_type", words))
    index = TfidfIndex.fit_worded(catalog, max_features)
    return index, index.transform_worded(catalog).drop("words")
