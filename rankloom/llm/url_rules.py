"""URL filters: explicit host and path rules, then association rules of URL tokens.

Everything is DataFrame code and Spark's own FP-growth; no Python runs on the executors.

Explicit rules name a host and a path prefix, hold for the host and its
subdomains, and the longest fitting one decides. Where none fits, mined rules
do: the labelled URLs are turned into token sets, FP-growth finds token
combinations that go with the bad label, and those that reach the wanted
support and confidence are kept. An inverted index (one posting per rule, under
its rarest token) names the candidate rules of an URL; a candidate holds if all
its tokens are in the URL.

Defined results: a null URL, or one without ``://``, has an empty host and path
and no tokens, so it is allowed. An empty table gives an empty result, and
without a bad label nothing is mined and everything is allowed. Repeated rows
give repeated results. A null label counts as no label.
"""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.session import shared_folder

BAD = "=bad"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of an URL, both empty without ``://``."""
    pattern = "://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(text, pattern, 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(text, pattern, 2)


def explicit_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule as text and its action, or nulls.

    ``rules`` are (action, host + path prefix) pairs such as ``("block", "com/de/")``;
    equally long ones rank by the order given.
    """
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        name, _, prefix = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + prefix)
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(action)
    return rule, action


def url_tokens(url: Column) -> Column:
    """The distinct tokens of an URL: host labels, registered name, path segments, query names.

    Digits count as ``#``, so that numbered pages share a token.
    """
    text = F.coalesce(url, F.lit(""))
    host, path = host_and_path(text)
    query = F.regexp_extract(text, "://[^?#]*\\?([^#]*)", 1)
    plain = lambda c: F.regexp_replace(c, "[0-9]+", "#")
    labels = F.transform(F.split(host, "\\."), lambda x: F.concat(F.lit("h:"), plain(x)))
    parts = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), plain(x)))
    names = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("q:"), plain(F.substring_index(x, "=", 1))))
    return F.array_distinct(F.filter(F.concat(labels, parts, names), lambda x: F.length(x) > 2))


def mine_rules(labelled: DataFrame, min_support: float = 0.005, min_confidence: float = 0.9) -> DataFrame:
    """(rule_id, tokens, confidence, support) of token sets that go with the bad label.

    ``labelled`` has ``url`` and boolean ``bad``. ``min_support`` is the share of
    all labelled URLs that hold the tokens and are bad. A rule that needs more
    tokens than another without gaining confidence is pruned.
    """
    shared_folder(labelled.sparkSession)
    baskets = labelled.where("bad is not null").select(
        F.concat(url_tokens(F.col("url")), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items")
    ).checkpoint()
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD))).select(
        F.array_sort("antecedent").alias("tokens"), "confidence", "support"
    ).checkpoint()
    # One posting per rule and token of it; a shorter rule inside a longer one meets it there.
    posted = found.select(F.explode("tokens").alias("token"), "tokens", "confidence")
    inner = posted.select("token", F.col("tokens").alias("less"), F.col("confidence").alias("as_sure"))
    beaten = posted.join(inner, "token").where(
        (F.size("less") < F.size("tokens")) & (F.size(F.array_except("less", "tokens")) == 0) & (F.col("as_sure") >= F.col("confidence"))
    ).select("tokens").distinct()
    kept = found.join(beaten, "tokens", "left_anti")
    return kept.select(F.xxhash64("tokens").alias("rule_id"), "tokens", "confidence", "support")


def matching(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule_id, confidence) of every mined rule that an URL fulfils; ``urls`` are distinct.

    Each rule is posted under its rarest token among all rules' tokens, so an
    URL meets few candidates.
    """
    token = rules.select("rule_id", F.explode("tokens").alias("token"))
    often = token.groupBy("token").agg(F.count("*").alias("uses"))
    post = (
        token.join(often, "token").groupBy("rule_id").agg(F.min(F.struct("uses", "token")).alias("least"))
        .join(rules, "rule_id").select("rule_id", "tokens", "confidence", F.col("least.token").alias("token"))
    )
    asked = urls.withColumn("has", url_tokens(F.col("url"))).select("url", "has", F.explode("has").alias("token"))
    met = asked.join(post, "token").where(F.size(F.array_except("tokens", "has")) == 0)
    return met.select("url", "rule_id", "confidence")


def judge(pages: DataFrame, rules: list[tuple[str, str]], mined: DataFrame) -> DataFrame:
    """``pages`` (page_id, url) with host, path, rule, verdict and the mined rule's confidence."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, action = explicit_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "action": action})
    # A repeated URL is matched once; only those that no explicit rule decides are asked.
    open_urls = rows.where("action is null and url is not null").select("url").distinct()
    hits = matching(open_urls, mined).groupBy("url").agg(F.max("confidence").alias("mined_confidence"))
    verdict = F.coalesce("action", F.when(F.col("mined_confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    judged = rows.join(hits, "url", "left")
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("action").isNull(), F.col("mined_confidence")).alias("mined_confidence"))
