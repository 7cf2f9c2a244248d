"""Links and catalog rows of a ``pages(page_id, url, html)`` table."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.html import page_description, page_name, read_pages
from rankloom.schemas import DESCRIPTION, NAME, URL
from rankloom.session import shared_folder

# An opening a tag. Comments and scripts hold no tags. Possessive loops keep
# long tags off the stack.
_NO_TAGS = r"(?is)<!--.*?-->|<script\b.*?</script\s*>"
_ANCHOR = r"""(?i)<a\s(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
# One attribute after the other, so that a value can't be taken for a name.
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


def _href(tag: str) -> str:
    """The decoded value of a tag's first href, or nothing."""
    for name, *values in _ATTRIBUTE.findall(tag[2:-1]):
        if name.lower() == "href":
            return unescape("".join(values)).strip()
    return ""


def _resolved(href: str, base: str) -> str | None:
    """The absolute link without fragment and query, dot segments resolved; None if it is no URL at all."""
    try:
        return re.sub(r"[?#].*", "", urljoin(base, href), flags=re.DOTALL)
    except ValueError:
        return None


def link_arrays(pages: DataFrame, marker: str, base: str) -> DataFrame:
    """(page_id, links): the distinct links of each page that hold the marker, in order.

    Links are made absolute as a browser does. ``base`` is scheme and host. A
    page without content has no links. Spark finds the tags; only they reach
    Python, which reads them once.
    """
    base = base.rstrip("/") + "/"
    tags = F.regexp_extract_all(F.regexp_replace("html", _NO_TAGS, ""), F.lit(_ANCHOR), F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page in batch.column(1).to_pylist():
                hrefs = (_href(tag) for tag in page or ())
                found = (_resolved(h, base) for h in hrefs if h and marker in h)
                rows.append(list(dict.fromkeys(link for link in found if link is not None)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.string()))], ["page_id", "links"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", tags.alias("tags")).mapInArrow(run, f"page_id {kind}, links array<string>")


def page_links(arrays: DataFrame) -> DataFrame:
    """(page_id, link), one row per distinct link of a page."""
    return arrays.select("page_id", F.explode("links").alias("link"))


def first_pages(links: DataFrame) -> DataFrame:
    """Each distinct link with the first page that shows it."""
    return links.groupBy("link").agg(F.min("page_id").alias("first_page"))


def new_link_counts(links: DataFrame) -> DataFrame:
    """How many links each page shows for the first time."""
    return first_pages(links).groupBy(F.col("first_page").alias("page_id")).agg(
        F.count(F.lit(1)).alias("n_new")
    )


def until_empty(arrays: DataFrame, max_page: int | None = None) -> DataFrame:
    """Links of the pages before the first one without any, and up to ``max_page``."""
    # Written once, as both the stop and the links are read from them.
    shared_folder(arrays.sparkSession)
    arrays = arrays.checkpoint()
    # One value, null if every page has links.
    stop = arrays.where(F.size("links") == 0).agg(F.min("page_id").alias("stop")).scalar()
    kept = arrays.where(F.coalesce(F.col("page_id") < stop, F.lit(True)))
    return page_links(kept if max_page is None else kept.where(F.col("page_id") <= max_page))


def catalog_rows(pages: DataFrame, site_suffix: str = "") -> DataFrame:
    """page_id and the raw catalog columns; failed pages are left out."""
    read = read_pages(pages.where(F.col("html").isNotNull()).select("page_id", "url", "html"))
    return read.select(
        "page_id",
        page_name(F.col("h1"), F.col("title"), site_suffix).alias(NAME),
        page_description(F.col("paragraph")).alias(DESCRIPTION),
        F.col("url").alias(URL),
    )


def coverage(rows: DataFrame, target: int) -> DataFrame:
    """Rows found, and as a percentage of a target number."""
    return rows.agg(
        F.count(F.lit(1)).alias("n_items"),
        (F.count(F.lit(1)) * 100 / F.lit(float(target))).alias("coverage_pct"),
    )
