"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import bpe, chat, fill_middle, host_rules, mixing, periodic, quality_trees, repeats, simhash, tiling, token_counts, url_rules, warc

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


ADDED_CONVERSATION = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


@query
def op1_chat_round_trip(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame(ADDED_CONVERSATION, "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(rows.unionByName(added)))


@query
def op2_benchmark_tiles(spark, sf):
    found = tiling.matches(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "item_id", "item_words", "covered_words", F.size("tiles").alias("n_tiles"))


@query
def op3_token_counts(spark, sf):
    """Tokens of source, lang and text, and of the text's lines, from one encoding of the three."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "text")
    ranks = token_counts.share_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    counted = token_counts.attribute(docs, ranks, public_tokenizers.PATTERN, ["source", "lang", "text"])
    at = F.col("field_tokens")
    return counted.select(
        "doc_id", "n_tokens", "n_crossing", at[0].alias("source_tokens"), at[1].alias("lang_tokens"), at[2].alias("text_tokens"), "section_tokens"
    )


@query
def op4_maximal_repeats(spark, sf):
    rest = repeats.without_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    return rest.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def quality_forest(spark, sf):
    """Trees fitted to the documents table and those of its labels that are not held out."""
    labels = table(spark, sf, "labels").where(~quality_trees.held_out(F.col("doc_id")))
    return quality_trees.train(table(spark, sf, "documents"), labels.select("doc_id", F.col("quality").alias("label")))


@query
def op5_quality_trees(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    scored = quality_trees.score(docs, quality_forest(spark, sf))
    return scored.select(
        "doc_id", quality_trees.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query
def op6_bpe_round_trip(spark, sf):
    vocabulary = bpe.share_vocabulary(spark, public_tokenizers.path("byte_bpe_50k.json"))
    both = bpe.round_trip(table(spark, sf, "documents").select("doc_id", "text"), vocabulary, as_text=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op7_warc_transactions(spark, sf):
    made = warc.round_trip(table(spark, sf, "pages").select("page_id", "url", "html"))
    return made.select("metadata.page_id", "response.payload_bytes", "response.payload_digest", F.col("response.type").alias("record_type"), "metadata.refers_to")


ORACLES["op7_warc_transactions"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS s FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY page_id DESC) AS k, max(page_id) OVER (PARTITION BY s) AS best FROM p)
SELECT page_id, payload_bytes,
  (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(('0x' || substr(s, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8)) & 31 AS INTEGER), 1), '' ORDER BY i) FROM range(32) t(i)) AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN k > 1 THEN best END AS refers_to
FROM r
"""


@query
def op8_host_rules(spark, sf):
    judged = host_rules.judge(table(spark, sf, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLES["op8_host_rules"] = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), g AS (
  SELECT row_number() OVER () AS r, *,
    [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)] AS gs
  FROM w
), e AS (SELECT r, unnest(gs) AS gram, unnest(range(0, len(gs))) AS i FROM g),
d AS (SELECT r, i FROM e QUALIFY count(*) OVER (PARTITION BY r, gram) > 1),
n AS (SELECT r, count(DISTINCT i + k) AS n FROM d, range(0, 3) s(k) GROUP BY r),
m AS (
  SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n.n, 0) AS BIGINT) AS n_repeat_words
  FROM g LEFT JOIN n USING (r)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS docs, count(*) FILTER (WHERE base_failed) AS failed FROM b WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT avg(failed / docs) AS m, var_pop(failed / docs) AS v FROM h),
s AS (SELECT m, CASE WHEN v > 1e-12 THEN least(greatest(m * (1 - m) / v - 1, 1), 1e6) ELSE 1e6 END AS z FROM p),
f AS (SELECT source FROM h, s WHERE (failed + m * z) / (docs + z) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM f)) AS kept
FROM b
"""

@query
def op9_simhash_classes(spark, sf):
    found = simhash.classes(table(spark, sf, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


@query
def op10_url_rules(spark, sf):
    """A page's label is that of the document of its number: bad is quality 0."""
    pages, labels = table(spark, sf, "pages").select("page_id", "url"), table(spark, sf, "labels")
    labelled = pages.join(labels.select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad")), "page_id")
    judged = url_rules.judge(pages, URL_RULES, url_rules.mine_rules(labelled.select("url", "bad")))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query
def op11_fill_middle(spark, sf):
    made = fill_middle.transform(table(spark, sf, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id", F.col("units").alias("n"), "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_middle.restored(), 256).alias("restored_sha256"),
    )


ORACLES["op11_fill_middle"] = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
k AS (
  SELECT *, ('0x' || substr(s, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(s, 9, 8))::BIGINT % (n + 1) AS c2,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(s, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || substr(s, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), p AS (
  SELECT *, substr(t, 1, least(c1, c2)) AS pre, substr(t, 1 + least(c1, c2), abs(c1 - c2)) AS mid, substr(t, 1 + greatest(c1, c2)) AS suf FROM k
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN least(c1, c2) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN abs(c1 - c2) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


def with_planted_runs(docs):
    """Every tenth document, by the hash of its id, repeats a stretch of its words to its end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    found = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("words")).withColumn("n", F.size("words"))
    placed = found.withColumn("a", F.expr("if(n > 0, int(g % n), null)")).withColumn("p", F.expr("int(1 + (n - a) div (3 + g % 8))"))
    repeated = F.expr("slice(flatten(array_repeat(slice(words, a + 1, p), int(ceil((n - a) / p)))), 1, n - a)")
    made = F.array_join(F.concat(F.slice("words", 1, F.col("a")), repeated), " ")
    return placed.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


@query
def op12_periodic_runs(spark, sf):
    made = periodic.find_runs(with_planted_runs(table(spark, sf, "documents")))
    listed = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    listed = F.concat(F.array_join(listed, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return made.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op13_source_mix(spark, sf):
    mixed = mixing.mix(mixing.with_size(table(spark, sf, "documents").select("doc_id", "source", "text")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
