import unicodedata

import pytest
from pyspark.sql import functions as F

from rankloom.functions import text as tx
from rankloom.functions.tokens import with_terms, words
from rankloom.operators import clean, rank, rerank


def one(spark, value, function):
    frame = spark.createDataFrame([(value,)], "v string")
    return frame.select(function(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "text, want",
    [
        ("  a  b\tc\nd  ", "a b c d"),
        ("\x1ca\x85b　", "a b"),
        ("plain", "plain"),
        ("a  b \t c\td", "a b c d"),
        ("\t", ""),
        (" ", ""),
    ],
)
def test_collapse_space(spark, text, want):
    assert one(spark, text, tx.collapse_space) == want


def test_trim_space_keeps_inner(spark):
    assert one(spark, " \n a \t b\r\n", tx.trim_space) == "a \t b"


@pytest.mark.parametrize(
    "text, want",
    [
        ("Useful words first. OUTDATED browser detected here\nand the next line stays", "Useful words first. and the next line stays"),
        ("Latest browser options  still the same line\nkept because it is the next line", "kept because it is the next line"),
        ("Enough words to be kept. OUTDATED BROWſER DETECTED and more", "Enough words to be kept."),
        ("Enough words to be kept. ı understand and wİsh to contInue", "Enough words to be kept."),
        ("see the page http://a.b/c right now", "see the page  right now"),
        ("www.example.com and enough other words here", " and enough other words here"),
        ("1234567890123456789", tx.SHORT_DESCRIPTION),
        ("12345678901234567890", "12345678901234567890"),
        (None, tx.NO_DESCRIPTION),
        ("", tx.SHORT_DESCRIPTION),
    ],
)
def test_clean_description(spark, text, want):
    frame = spark.createDataFrame([(text,)], "description string")
    assert tx.with_clean_description(frame).first().description == want


def test_link_blank_counts_and_collapses_only_in_embedding_text(spark):
    raw = spark.createDataFrame([("N  ame", "see the page http://a.b/c right now")], "name string, description string")
    row = clean.clean_texts(raw).first()
    assert len(row.description) == 23
    assert row.embedding_text == "N ame. see the page right now"


@pytest.mark.parametrize(
    "name, want",
    [
        ("OPQ Java", "Personality & Behavior"),
        ("JavaScript", "Technical Skills"),
        (".NET", "Technical Skills"),
        ("xnet", "General"),
        ("Verify", "Cognitive"),
        ("Writing Exercise", "Simulation"),
        ("Written Language", "Language"),
        ("Plain", "General"),
    ],
)
def test_classify(spark, name, want):
    assert one(spark, name, tx.classify) == want


@pytest.mark.parametrize(
    "url, want", [("https://X/Y/ABC//", "abc"), (" https://x/y/z ", "z"), ("one", "one"), ("///", ""), (None, None)]
)
def test_slug(spark, url, want):
    assert one(spark, url, tx.slug) == want


def test_shorten(spark):
    assert one(spark, "x" * 250, tx.shorten) == "x" * 200 + "..."
    long = "ab " * 100
    assert one(spark, long, tx.shorten) == long[:200].rsplit(" ", 1)[0] + "..."
    assert one(spark, "x" * 200, tx.shorten) == "x" * 200


def test_labels_and_percent(spark):
    frame = spark.createDataFrame([(0.75,), (0.7499,), (0.6,), (0.59,), (0.125,)], "s double")
    rows = frame.select(tx.match_label(F.col("s")).alias("l"), tx.match_percent(F.col("s")).alias("p")).collect()
    assert [r.l.split()[0] for r in rows] == ["Excellent", "Good", "Good", "Fair", "Fair"]
    assert [r.p for r in rows] == [75, 75, 60, 59, 13]


def test_query_checks(spark):
    frame = spark.createDataFrame([("  ",), ("short",), ("x" * 20,), ("x" * 50,), (None,)], "q string")
    rows = frame.select(tx.query_status(F.col("q")).alias("s"), tx.query_warning(F.col("q")).alias("w")).collect()
    assert [r.s for r in rows] == ["empty", "too_short", "ok", "ok", "empty"]
    assert [r.w for r in rows] == [True, True, True, False, False]


def test_session_default(spark):
    frame = spark.createDataFrame([("s1",), ("",), (None,)], "s string")
    got = [r.s for r in frame.select(tx.session_or_new(F.col("s")).alias("s")).collect()]
    assert got[0] == "s1" and len(got[1]) == 36 and len(got[2]) == 36 and got[1] != got[2]


def test_words_and_pairs(spark):
    assert one(spark, "Tea a Été_2, x b-42!", words) == ["tea", "été_2", "42"]
    assert one(spark, None, words) == []
    frame = spark.createDataFrame([("one a two three",), ("solo",), ("",)], "t string")
    terms = [r.terms for r in with_terms(frame, "t").collect()]
    assert terms == [["one", "two", "three", "one two", "two three"], ["solo"], []]


def test_digit_class_covers_every_digit(spark):
    digits = [chr(c) for c in range(0x110000) if chr(c).isdigit()]
    others = ["a", " ", "-", "½", "Ⅰ", "一", "."]
    frame = spark.createDataFrame([(d,) for d in digits + others], "c string")
    rows = {r.c: r.m for r in frame.select("c", F.col("c").rlike("^" + rerank.DIGIT).alias("m")).collect()}
    missed = [hex(ord(d)) for d in digits if not rows[d]]
    # Java may know an older Unicode version than Python.
    assert all(unicodedata.category(chr(int(m, 16))) == "Nd" for m in missed) and len(missed) <= 30
    assert not any(rows[o] for o in others)


def test_keep_first_and_null_keys(spark):
    rows = [(3, "u", "c"), (1, "u", "a"), (2, None, "n1"), (5, None, "n2"), (4, "v", "d")]
    frame = spark.createDataFrame(rows, "seq int, url string, name string")
    for salts in (1, 3):
        kept = rank.top_rows(frame.repartition(3), ["url"], [F.col("seq")], 1, salts=salts)
        assert sorted(r.seq for r in kept.collect()) == [1, 2, 4]
    counts = clean.duplicates_removed(frame, "url").first()
    assert (counts.n_rows, counts.n_kept, counts.n_removed) == (5, 3, 2)


def test_clean_catalog(spark):
    rows = [
        (1, " A  test ", None, "u1"),
        (2, "dup", "ignored, as the first url wins here", "u1"),
        (3, None, "no name at all in this row", "u2"),
        (4, "no url", "text", None),
        (5, "Python", "A long enough description of it", "u5"),
    ]
    frame = spark.createDataFrame(rows, "seq int, name string, description string, url string")
    got = [(r.name, r.description, r.item_type) for r in clean.clean_catalog(frame).orderBy("seq").collect()]
    assert got == [
        ("A test", tx.NO_DESCRIPTION, "General"),
        ("Python", "A long enough description of it", "Technical Skills"),
    ]


def test_hot_key_is_narrowed_before_the_shuffle(spark):
    """A key holding a third of the rows leaves each map task as one row."""
    frame = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("key")
    )
    plan = rank.keep_first(frame, "key", "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.index("Partial") > plan.index("Exchange")
    assert rank.keep_first(frame, "key", "id").count() == 2001
