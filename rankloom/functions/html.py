"""Name and description of a web page, read from its tags inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions.text import NO_DESCRIPTION, shorten, trim_space

# What makes a paragraph a description, and the default name.
MIN_PARAGRAPH = 50
NOT_A_DESCRIPTION = ["cookie", "privacy", "speak to"]
DESCRIPTION_LIMIT = 200
UNKNOWN_NAME = "Unknown Assessment"
# Pages of an Arrow batch that are Python strings at a time.
PAGE_ROWS = 64

# Elements that never hold content (HTML standard, with the obsolete ones).
_VOID = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen link "
    "menuitem meta nextid param source spacer track wbr".split()
)
# Text anywhere inside these belongs to no heading or paragraph.
_NOT_TEXT = ("script", "style", "template", "rt", "rp")


class _PageText(HTMLParser):
    """Collects trimmed text pieces and which of them each h1, title and p holds.

    An end tag closes the nearest open element of its name and all inside it;
    a new ``p`` does not close an open one. Elements are ranges of pieces, so
    nested paragraphs take no extra space.
    """

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.pieces: list[str] = []
        self.spans: dict[str, list[list[int]]] = {"h1": [], "title": [], "p": []}
        self._open: list[tuple[str, list[int] | None]] = []
        self._count: dict[str, int] = {}
        self._text: list[str] = []

    def _flush(self):
        if self._text:
            piece = "".join(self._text).strip()
            self._text.clear()
            if piece and not any(self._count.get(tag) for tag in _NOT_TEXT):
                self.pieces.append(piece)

    def handle_starttag(self, tag, attrs):
        self._flush()
        if tag in _VOID:
            return
        span = None
        if tag in self.spans:
            span = [len(self.pieces), -1]
            self.spans[tag].append(span)
        self._open.append((tag, span))
        self._count[tag] = self._count.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._flush()
        if not self._count.get(tag):
            return
        while True:
            name, span = self._open.pop()
            self._count[name] -= 1
            if span is not None:
                span[1] = len(self.pieces)
            if name == tag:
                return

    def handle_data(self, data):
        self._text.append(data)

    def handle_entityref(self, name):
        self._text.append(html5.get(name + ";") or html5.get(name) or "&" + name)

    def handle_charref(self, name):
        self._text.append(unescape(f"&#{name};"))

    def handle_comment(self, data):
        self._flush()

    def handle_decl(self, decl):
        self._flush()

    def handle_pi(self, data):
        self._flush()

    def unknown_decl(self, data):
        self._flush()

    def text(self, span):
        end = len(self.pieces) if span[1] < 0 else span[1]
        return "".join(self.pieces[span[0] : end])


def _wanted_texts(page: str) -> tuple[str | None, str | None, str | None]:
    parser = _PageText()
    parser.feed(page)
    parser.close()
    parser._flush()
    heads = [parser.text(parser.spans[t][0]) if parser.spans[t] else None for t in ("h1", "title")]
    for span in parser.spans["p"]:
        text = parser.text(span)
        lowered = text.lower()
        if len(text) > MIN_PARAGRAPH and not any(w in lowered for w in NOT_A_DESCRIPTION):
            return heads[0], heads[1], text
    return heads[0], heads[1], None


def read_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without ``html`` but with h1, title and paragraph; rows that can't be read are left out.

    Reading and leaving out are one step, so no filter makes Spark read a page twice.
    """
    others = [f for f in pages.schema if f.name not in (html, "h1", "title", "paragraph")]
    schema = T.StructType([*others, *(T.StructField(n, T.StringType()) for n in ("h1", "title", "paragraph"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages, rest = batch.column(html), batch.select([f.name for f in others])
            for at in range(0, batch.num_rows, PAGE_ROWS):
                texts, read = [], []
                for page in pages.slice(at, PAGE_ROWS).to_pylist():
                    try:
                        texts.append(_wanted_texts(page))
                        read.append(True)
                    except Exception:
                        read.append(False)
                kept = rest.slice(at, PAGE_ROWS).filter(pa.array(read, pa.bool_()))
                made = [pa.array([t[k] for t in texts], pa.string()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*kept.columns, *made], schema.names)

    return pages.mapInArrow(run, schema)


def page_name(h1: Column, title: Column, site_suffix: str = "") -> Column:
    """First heading; if it is empty the title less the site's suffix; else a default."""
    fallback = title
    if site_suffix:
        fallback = F.replace(title, F.lit(site_suffix), F.lit(""))
    return F.coalesce(
        F.nullif(h1, F.lit("")), F.nullif(trim_space(fallback), F.lit("")), F.lit(UNKNOWN_NAME)
    )


def page_description(paragraph: Column) -> Column:
    return F.coalesce(F.nullif(shorten(paragraph, DESCRIPTION_LIMIT), F.lit("")), F.lit(NO_DESCRIPTION))
