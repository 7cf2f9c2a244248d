import pytest
from pyspark.sql import functions as F

from rankloom.functions.html import _wanted_texts
from rankloom.operators import pages
from rankloom.plans.catalog import catalog_from_pages

LONG = "This paragraph is easily longer than fifty characters, as it must be."


@pytest.mark.parametrize(
    "html, want",
    [
        ("<h1> A <b>b</b> c </h1>", ("Abc", None, None)),
        ("<h1></h1><title>T | Site</title>", ("", "T | Site", None)),
        ("<h1>one</h1><h1>two</h1>", ("one", None, None)),
        (f"<p>short</p><p>{LONG}</p>", (None, None, LONG)),
        (f"<p>{LONG} Cookie</p><p>Please SPEAK TO us, {LONG}</p><p>{LONG}</p>", (None, None, LONG)),
        # A new p does not close the open one, so its text counts to both.
        (f"<p>a<p>{LONG}</p>", (None, None, "a" + LONG)),
        (f"<div><p>a</div><p>{LONG}</p>", (None, None, LONG)),
        (f'<script>var t="</p><p>{LONG}";</script><p>{LONG}!</p>', (None, None, LONG + "!")),
        (f"<p>x<script>{LONG}</script></p>", (None, None, None)),
        (f"<p>x<!-- {LONG} --></p>", (None, None, None)),
        ("<h1>a &amp; b &lt;c&gt; &#233; &eacute; AT&T</h1>", ("a & b <c> é é AT&T", None, None)),
        ("<h1>cut &amp</h1>", ("cut &", None, None)),
        ("<h1>open <br> end", ("openend", None, None)),
        ("</p></h1>text", (None, None, None)),
        ("", (None, None, None)),
    ],
)
def test_page_texts(html, want):
    assert _wanted_texts(html) == want


def test_catalog_rows(spark):
    rows = [
        (1, "u1", f"<h1>Name</h1><p>{LONG}</p>"),
        (2, "u2", "<title>Only title | Site</title><p>short</p>"),
        (3, "u3", "<p></p>"),
        (4, "u4", None),
        (5, "u5", "<h1>N</h1><p>" + "word " * 60 + "</p>"),
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r["Assessment Name"], r["Short Description"]) for r in pages.catalog_rows(frame, " | Site").collect()}
    assert got[1] == ("Name", LONG)
    assert got[2] == ("Only title", "No description available")
    assert got[3][0] == "Unknown Assessment"
    assert 4 not in got
    assert got[5][1] == ("word " * 60)[:200].rsplit(" ", 1)[0] + "..."
    cover = pages.coverage(pages.catalog_rows(frame), 8).first()
    assert (cover.n_items, cover.coverage_pct) == (4, 50.0)
    assert catalog_from_pages(frame, " | Site").count() == 4


PAGES = [
    (1, '<a href="/view/a?x=1#f">a</a><a class="q" href=\'/view/a\'>b</a><A HREF=/view/b>c</A><a href="/other">d</a>'),
    (2, '<a href="https://site.test/view/a#top">x</a><a href="//cdn.test/view/c">x</a><a href="../view/d">x</a><a name="/view/z">n</a>'),
    (3, "<!-- <a href='/view/e'> --><script>'<a href=\"/view/f\">'</script><p>none</p>"),
    (4, '<a href="/view/g&amp;h">late</a>'),
    (5, None),
]


def test_links(spark):
    frame = spark.createDataFrame(PAGES, "page_id long, html string")
    arrays = pages.link_arrays(frame, "/view/", "https://site.test")
    got = {}
    for r in pages.page_links(arrays).collect():
        got.setdefault(r.page_id, set()).add(r.link.replace("https://site.test", ""))
    assert got == {1: {"/view/a", "/view/b"}, 2: {"/view/a", "https://cdn.test/view/c", "/view/d"}, 4: {"/view/g&h"}}
    links = pages.page_links(arrays)
    assert {(r.page_id, r.n_new) for r in pages.new_link_counts(links).collect()} == {(1, 2), (2, 2), (4, 1)}
    # Page 3 has no links, so page 4 is never reached.
    assert {r.page_id for r in pages.until_empty(arrays).collect()} == {1, 2}
    assert {r.page_id for r in pages.until_empty(arrays, 1).collect()} == {1}
    assert pages.until_empty(arrays.where("page_id < 3")).count() == 5


def test_long_tags_do_not_overflow(spark):
    html = '<a data-x="' + "y" * 200_000 + '" href="/view/q">t</a>'
    frame = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert pages.page_links(pages.link_arrays(frame, "/view/", "https://s.test")).first().link == "https://s.test/view/q"


def executed(frame):
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


def test_pages_are_read_once(spark):
    frame = spark.createDataFrame([(1, "u", f"<h1>N</h1><p>{LONG}</p>")], "page_id long, url string, html string")
    for made in (pages.catalog_rows(frame).select("page_id", "Assessment Name"), catalog_from_pages(frame)):
        assert made._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_link_patterns_run_once(spark):
    frame = spark.createDataFrame(PAGES, "page_id long, html string").repartition(2)
    plan = pages.page_links(pages.link_arrays(frame, "/view/", "https://site.test"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    stop = pages.until_empty(pages.link_arrays(frame, "/view/", "https://site.test"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in stop


@pytest.mark.parametrize(
    "tag, link",
    [
        ('<a href="/view/x/../y/./z">', "/view/y/z"),
        ('<a title=" href=/view/no" href="/view/yes">', "/view/yes"),
        ('<a data-href="/view/no" href="/view/yes">', "/view/yes"),
        ('<a href="/view/caf&eacute;&#47;a&nbsp;b?q">', "/view/café/a\xa0b"),
        ("<a href=' /view/blank '>", "/view/blank"),
        ('<a href="/../../view/up">', "/view/up"),
    ],
)
def test_links_resolve_as_in_a_browser(spark, tag, link):
    frame = spark.createDataFrame([(1, tag)], "page_id long, html string")
    found = pages.page_links(pages.link_arrays(frame, "/view/", "https://s.test")).collect()
    assert [r.link for r in found] == ["https://s.test" + link]


def test_few_pages_of_a_batch_are_strings_at_a_time():
    import pyarrow as pa
    from pyspark.sql import types as T

    from rankloom.functions import html

    class Frame:
        schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("html", T.StringType())])

        def mapInArrow(self, run, schema):
            return run

    texts = [None if n % 50 == 7 else f"<title>t{n}</title><h1>h{n}</h1>" for n in range(1000)]
    made = list(html.read_pages(Frame())(iter([pa.record_batch({"page_id": list(range(1000)), "html": texts})])))
    assert max(b.num_rows for b in made) <= html.PAGE_ROWS
    rows = pa.Table.from_batches(made).to_pylist()
    assert [(r["page_id"], r["h1"], r["title"]) for r in rows] == [(n, f"h{n}", f"t{n}") for n in range(1000) if n % 50 != 7]
