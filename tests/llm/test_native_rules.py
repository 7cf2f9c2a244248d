import itertools
import random
import re
import string
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import host_rules, url_rules
from rankloom.llm.queries import URL_RULES

SPACES = r"[\x20\x09-\x0D]+"


def measured(text):
    text = text or ""
    words = [w for w in re.split(SPACES, text) if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), failed


TEXTS = [
    None, "", " \t\r\n\x0b\x0c", "a", "a b c", "a b c d", "a a a a", "a b c a b c", "x y z\nx y z\n\n \nx y z", "é# *$ %&|<> wörd", "a\x00b\xa0c d",
    "w " * 40_000, " ".join(map(str, range(60))), " ".join(map(str, range(60))) + " 1 2 3", " ".join(["p q r s"] * 30), "\n".join(["same line here"] * 60), "l1\r\nl1\r\nl2",
]


def test_measures(docs):
    found = host_rules.measure(docs(list(enumerate(TEXTS))).select("doc_id", "text", "source")).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for row in found:
        assert tuple(row[n] for n in names) == measured(row.text), row.text


def test_host_verdicts(spark):
    good, bad = " ".join(map(str, range(60))), "short"
    rows = [(h * 100 + i, good if i >= fails else bad, host) for h, (host, n, fails) in enumerate([("a", 40, 2), ("b", 40, 39), ("c", 2, 2), (None, 5, 1), ("d", 30, 1)]) for i in range(n)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_words", F.lit("x")).withColumn("_text", F.lit("y"))
    measures = host_rules.measure(frame.select("doc_id", "text", F.col("source").alias("_host")))
    found = {r.host: r for r in host_rules.host_verdicts(measures, "_host").collect()}
    rates = np.array([2 / 40, 39 / 40, 1.0, 1 / 30])
    m, v = rates.mean(), rates.var()
    strength = min(max(m * (1 - m) / v - 1, 1), 1e6)
    for host, (n, fails) in {"a": (40, 2), "b": (40, 39), "c": (2, 2), "d": (30, 1)}.items():
        assert found[host].rate == pytest.approx((fails + m * strength) / (n + strength))
    assert found["b"].host_failed and not found["a"].host_failed and None not in found
    kept = {r.doc_id: r.kept for r in host_rules.judge(frame).collect()}
    # The one good document of the bad host goes with it; a null host has no verdict.
    assert not kept[139] and kept[2] and not kept[0] and kept[304] and not kept[300] and len(kept) == len(rows)


def test_no_documents_and_no_hosts(docs):
    frame = docs([(1, "x"), (2, None)])
    assert host_rules.judge(frame.where("false")).count() == 0
    assert [r.kept for r in host_rules.judge(frame.withColumn("source", F.lit(None).cast("string"))).collect()] == [False, False]


URLS = [
    None, "", "no scheme/x", "https://Example.ORG/es/x", "http://a.example.org/en/1", "http://example.org/en/2", "http://x.com/fr/", "http://x.com/fr", "http://com/de/q?x", "http://notcom/de/",
    "http://xcom/de/", "https://a.b.org", "https://a.org?x://y/z", "x://y://z/p", "HTTP://ÄB.ORG/#f", "http://u@h.com:80/de/1#x", "http://example.org/es", "://h/p",
]


def judged(url):
    text = url or ""
    host = path = ""
    if "://" in text:
        rest = text.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    best = None
    for action, rule in URL_RULES:
        name, _, prefix = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + prefix) and (best is None or len(rule) > len(best[1])):
            best = action, rule
    return host, path, best


def test_explicit_rules(spark):
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(URLS)] + [(0, None, "h")], "page_id long, url string, host string")
    none = url_rules.mine_rules(pages.select("url", F.lit(None).cast("boolean").alias("bad")))
    found = url_rules.judge(pages, URL_RULES, none).collect()
    assert len(found) == len(URLS) + 1
    for row in found:
        host, path, best = judged(URLS[row.page_id])
        assert (row.host, row.path) == (host, path)
        assert (row.rule, row.verdict) == ((best[1], best[0]) if best else (None, "allow"))
    assert url_rules.judge(pages.where("false"), URL_RULES, none).count() == 0


def test_mined_rules(spark):
    urls = [(f"http://{('ads', 'www')[i % 2]}.s{i % 5}.net/{('win', 'read')[i // 2 % 2]}/{i}", i % 4 == 0) for i in range(400)]
    urls += [(None, True), ("http://x.y/z", None)]
    labelled = spark.createDataFrame(urls, "url string, bad boolean")
    mined = url_rules.mine_rules(labelled, 0.05, 0.9)
    rules = {frozenset(r.tokens): r for r in mined.collect()}
    # Only both tokens together tell; longer rules say no more and are pruned.
    assert set(rules) == {frozenset({"h:ads", "p:win"})}
    (rule,) = rules.values()
    assert rule.confidence == 1.0 and rule.support == pytest.approx(100 / 401)
    pages = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(urls)], "page_id long, url string")
    verdicts = {r.page_id: r.verdict for r in url_rules.judge(pages, [("allow", "s0.net/")], mined).collect()}
    for k, (url, _) in enumerate(urls):
        block = bool(url) and "ads" in url and "/win/" in url and ".s0." not in url
        assert verdicts[k] == ("block" if block else "allow"), url


def plain_tokens(url):
    """Tokens of an URL without a query, digits as #."""
    if not url or "://" not in url:
        return frozenset()
    host, *parts = re.sub("[0-9]+", "#", url.split("://", 1)[1]).split("/")
    return frozenset([f"h:{x}" for x in host.lower().split(".") if x] + [f"p:{x}" for x in parts if x])


@pytest.mark.parametrize("seed, support, confidence", [(1, 0.02, 0.7), (2, 0.01, 0.9), (3, 0.05, 0.6)])
def test_mined_rules_and_matches_equal_brute_force(spark, seed, support, confidence):
    rng = random.Random(seed)
    url = lambda: f"http://{rng.choice('abc')}.{rng.choice('xyz')}{rng.randint(1, 99)}.net/{rng.choice(['win', 'read', 'go'])}/{rng.choice('pq')}"
    labelled = [(u := url(), rng.random() < (0.9 if "win" in u and "//a" in u or "/q" in u and "x" in u else 0.2)) for _ in range(400)] + [(None, True), ("http://a", None)]
    counted, bad = Counter(), Counter()
    known = [(plain_tokens(u), b) for u, b in labelled if b is not None]
    for tokens, is_bad in known:
        for size in range(1, len(tokens) + 1):
            for part in map(frozenset, itertools.combinations(sorted(tokens), size)):
                counted[part] += 1
                bad[part] += is_bad
    sure = {s: bad[s] / n for s, n in counted.items() if bad[s] >= support * len(known) and bad[s] / n >= confidence}
    want = {s: c for s, c in sure.items() if not any(less < s and sure[less] >= c for less in sure)}
    mined = url_rules.mine_rules(spark.createDataFrame(labelled, "url string, bad boolean"), support, confidence)
    found = {frozenset(r.tokens): r for r in mined.collect()}
    assert set(found) == set(want) and want
    for s, row in found.items():
        assert row.confidence == pytest.approx(want[s]) and row.support == pytest.approx(bad[s] / len(known))
    asked = [url() for _ in range(200)] + [None, "", "http://new.org/win"]
    pages = spark.createDataFrame(list(enumerate(asked)), "page_id long, url string")
    for row in url_rules.judge(pages, [], mined).collect():
        fits = [c for s, c in want.items() if s <= plain_tokens(asked[row.page_id])]
        assert row.verdict == ("block" if fits else "allow") and row.mined_confidence == (pytest.approx(max(fits)) if fits else None)
