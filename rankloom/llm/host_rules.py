"""Quality rules at the level of hosts, as DataFrame expressions only.

Every text is measured by itself, and fails the base rules or not. Failures are
counted by host, the rates are shrunk towards the rate of all hosts with a beta
prior fitted to the hosts themselves, and a host whose shrunk rate is too high
takes its documents along.

Defined results: a null or blank text has no words, so it fails the base rules.
Documents of a null host are judged by the base rules alone. An empty table
gives an empty result; repeated rows count and come back as often as they are
there. Ties need no rule: every verdict is a function of counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.session import shared_folder

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Repeats are found per text by sorting its windows of three words, so nothing
    is shuffled, and only texts with a repeated window are sorted.
    """
    body = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    blank = "[\\x20\\x09-\\x0D]+"
    counted = body.withColumns({
        "_words": F.expr(f"filter(split(_text, '{blank.replace(chr(92), chr(92) * 2)}'), w -> w <> '')"),
        "_lines": F.expr("filter(split(_text, '\\n'), l -> translate(l, ' \\t\\u000b\\f\\r', '') <> '')"),
        "word_chars": F.length(F.translate("_text", SPACE, "")).cast("long"),
        "n_symbols": (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long"),
    })
    windows = counted.withColumns({
        "n_words": F.size("_words").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_grams": F.expr(
            "if(size(_words) < 4, array(), transform(sequence(0, size(_words) - 3), "
            "i -> concat(get(_words, i), ' ', get(_words, i + 1), ' ', get(_words, i + 2))))"
        ),
    }).drop("_words", "_lines", "_text")
    ordered = windows.withColumn(
        "_ordered",
        F.expr("if(size(array_distinct(_grams)) < size(_grams), sort_array(transform(_grams, (g, i) -> struct(g, i))), array())"),
    ).drop("_grams")
    repeated = ordered.withColumn(
        "_at", F.expr("filter(transform(_ordered, (x, k) -> if(x.g = get(_ordered, k - 1).g or x.g = get(_ordered, k + 1).g, x.i, null)), i -> i is not null)")
    ).drop("_ordered")
    measured = repeated.withColumn(
        "n_repeat_words", F.expr("size(array_distinct(flatten(transform(_at, i -> array(i, i + 1, i + 2)))))").cast("long")
    ).drop("_at")
    return measured.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


def host_verdicts(measured: DataFrame, host: str, max_rate: float = 0.5) -> DataFrame:
    """(host, n_docs, n_failed, rate, host_failed), one row per host that is not null.

    With p the failure rates of the hosts, m their mean and v their variance, the
    prior is Beta(a, b) of the same mean and variance: a + b = m(1-m)/v - 1, kept
    within 1 and 1000000; equal rates mean the strongest prior. The shrunk rate
    is (failed + a) / (docs + a + b).
    """
    per_host = measured.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed")
    )
    rate = F.col("n_failed") / F.col("n_docs")
    prior = per_host.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v")).select(
        "m", F.expr("if(v > 1e-12, least(greatest(m * (1 - m) / v - 1, 1D), 1e6D), 1e6D)").alias("strength")
    )
    # Two numbers; without any host there are none, and no row that would need them.
    mean, strength = (x or 0.0 for x in prior.first())
    shrunk = per_host.withColumn("rate", (F.col("n_failed") + F.lit(mean) * F.lit(strength)) / (F.col("n_docs") + F.lit(strength)))
    return shrunk.select("host", "n_docs", "n_failed", "rate", (F.col("rate") > max_rate).alias("host_failed"))


def judge(docs: DataFrame, host: str = "source", max_rate: float = 0.5, salts: int = 64) -> DataFrame:
    """Measured ``docs`` (doc_id, the host column and the counts) with ``kept``.

    The measures are written once to the shared folder: they are read for the
    hosts' rates and again for the verdicts. A host's documents meet its verdict
    in ``salts`` parts, to each of which the one row of a failing host is copied.
    """
    shared_folder(docs.sparkSession)
    measured = measure(docs.select("doc_id", F.col(host).alias("_host"), "text")).drop("text").checkpoint()
    failing = host_verdicts(measured, "_host", max_rate).where("host_failed")
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    failing = failing.select(F.col("host").alias("_host"), "host_failed", every)
    salted = measured.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(salts)).cast("int"))
    joined = salted.join(failing, ["_host", "_salt"], "left").drop("_salt")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("host_failed").isNull()).drop("host_failed").withColumnRenamed("_host", "host")
