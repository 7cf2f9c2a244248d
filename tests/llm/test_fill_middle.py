import hashlib
import random

import pytest

from rankloom.llm import fill_middle as fm


def plainly(doc_id, text, unit_ends):
    """The contract, read word by word: offsets from a given list of unit ends."""
    digest = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(unit_ends)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted([h1 % (n + 1), h2 % (n + 1)])
    a, b = ([0, *unit_ends][k] for k in (a, b))
    if h4 % 100 < 20:
        return n, "spm", a, b - a, "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b]
    return n, "psm", a, b - a, "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b]


def texts():
    rng = random.Random(3)
    yield from ["", "a", "\n", "é", "<P>", "a<S>b", "<M", "x" * 200_000 + "\n" + "é😀" * 40_000, "<" * 50, "S>" * 30, "<P" * 30]
    for _ in range(300):
        yield "".join(rng.choice("ab<>PSM é\n\r😀́") for _ in range(rng.randint(0, 60)))


def test_equals_the_contract_and_restores(spark, docs):
    rows = list(enumerate(texts()))
    frame = docs(rows).withColumnRenamed("key", "units").withColumnRenamed("_first", "__text")
    made = fm.transform(frame)
    assert made.columns == ["doc_id", "lang", "source", "n_chars", "__text", "units", "form", "prefix_chars", "middle_chars", "output"]
    found = {r.doc_id: r for r in made.withColumn("again", fm.restored()).collect()}
    forms = set()
    for i, t in rows:
        r = found[i]
        assert (r.units, r.form, r.prefix_chars, r.middle_chars, r.output) == plainly(i, t, range(1, len(t) + 1))
        assert r.again == t
        forms.add(r.form)
    assert forms == {"plain", "psm", "spm"} and len(found) == len(rows)


def test_nulls_repeated_rows_and_empty_tables(spark, docs):
    frame = docs([(None, None), (None, "no id"), (5, "same"), (5, "same")])
    got = sorted(tuple(r) for r in fm.transform(frame).select("units", "form", "output").collect())
    assert len(got) == 4 and got[0] == (0, "plain", "") and got[1] == got[2]
    assert fm.transform(frame.where("false")).count() == 0


def test_other_units_are_kept_whole():
    words = fm.Units(r"\s*\S+\s*")
    text = " one two\tthree  four\n" * 9
    ends = words.ends(text)
    assert len(ends) == 36 and ends[-1] == len(text) and all(text[e - 1].isspace() for e in ends)
    long = "word " * 200_000  # more than a block of units
    assert words.ends(long).tolist() == list(range(5, 1_000_001, 5))
    assert words.ends(long + " " * 70_000)[-1] == 1_070_000
    assert fm.Units("[ab]").ends("abc") is None and fm.Units("[ab]").ends("ab" * 100_000 + "c") is None
    assert fm.cut("abc", fm.Units("[ab]"), (1, 2, 3, 4))[:2] == (None, "plain")


@pytest.mark.parametrize("markers", [("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("aba", "x", "y"), ("", "x", "y"), ("abc", "b", "y")])
def test_markers_that_overlap_are_refused(markers):
    with pytest.raises(ValueError):
        fm.check_markers(markers)


def test_given_markers_pass():
    fm.check_markers(fm.MARKERS)
    fm.check_markers(("<fim_prefix>", "<fim_suffix>", "<fim_middle>"))
