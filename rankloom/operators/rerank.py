"""Re-ranking: prompt, answer parsing, title matching, fill and rank scores.

A query's candidate pool is bounded (20 rows), so it travels as one array and
everything below is built-in array functions on one row per query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions.text import no_type_filter, trim_space

# The wording of the prompt and the constants of the rank score.
PROMPT_HEAD = 'You are an expert HR assessment recommendation system.\n\nUser query: "'
PROMPT_CANDIDATES = '"\n\nCandidate assessments:\n'
PROMPT_SELECT = "\n\nSelect the "
PROMPT_TAIL = (
    " most relevant assessments for this job role.\n"
    "Return ONLY a numbered list of assessment names, nothing else."
)
MIN_TOP_SCORE = 0.3
RANK_STEP = 0.03
MAX_SCORE = 0.99

# Characters counted as digits: decimal numbers, and digits in other dress
# (superscript, subscript, circled and the like).
DIGIT = (
    r"[\p{Nd}²³¹፩-፱᧚⁰⁴-⁹₀-₉"
    r"①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾"
    r"➀-➈➊-➒\x{10A40}-\x{10A43}\x{10E60}-\x{10E68}\x{11052}-\x{1105A}"
    r"\x{1F100}-\x{1F10A}]"
)
CANDIDATE = ["rank", "item_id", "name", "url", "item_type", "score"]


def pack_pool(ranked: DataFrame) -> DataFrame:
    """(query_id, pool): a query's ranked candidates as one ordered array."""
    return ranked.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct(*CANDIDATE))).alias("pool")
    )


def prompt(query: Column, k: Column, pool: Column) -> Column:
    """The question put to the re-ranker."""
    lines = F.transform(
        pool, lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(c["name"], F.lit("")))
    )
    return F.concat(
        F.lit(PROMPT_HEAD), query,
        F.lit(PROMPT_CANDIDATES), F.array_join(lines, "\n"),
        F.lit(PROMPT_SELECT), k.cast("string"),
        F.lit(PROMPT_TAIL),
    )


def build_prompts(pools: DataFrame) -> DataFrame:
    """Add ``prompt`` to rows of (query_id, query, k, pool)."""
    return pools.withColumn("prompt", prompt(F.col("query"), F.col("k"), F.col("pool")))


def answer_prompts(
    prompts: DataFrame, load_answerer: Callable[[], Callable], batch_size: int | None = None, tasks: int | None = None
) -> DataFrame:
    """(query_id, content) from a caller's function, made once per task.

    Prompts are few and small but answers slow, so they are dealt to ``tasks``
    tasks (the cluster's cores by default) first. The function takes one prompt,
    or with ``batch_size`` a list of that many, and gives as many answers. A call
    that fails leaves its prompts without an answer; they keep their pool order.
    """
    schema = T.StructType([prompts.schema["query_id"], T.StructField("content", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer = load_answerer()

        def asked(texts):
            try:
                found = answer(texts[0]) if batch_size is None else answer(texts)
            except Exception:
                return [None] * len(texts)
            return [found] if batch_size is None else list(found)

        for batch in batches:
            for at in range(0, batch.num_rows, batch_size or 1):
                part = batch.slice(at, batch_size or 1)
                content = pa.array(asked(part.column("prompt").to_pylist()), pa.string())
                yield pa.RecordBatch.from_arrays([part.column("query_id"), content], ["query_id", "content"])

    dealt = prompts.select("query_id", "prompt").repartition(tasks or prompts.sparkSession.sparkContext.defaultParallelism)
    return dealt.mapInArrow(run, schema)


def parse_titles(content: Column) -> Column:
    """Titles of the numbered lines of an answer, in order; null stays null."""
    lines = F.split(trim_space(content), "\n")
    numbered = F.filter(lines, lambda s: s.rlike("^" + DIGIT) & s.contains(". "))
    return F.transform(numbered, lambda s: trim_space(F.split(s, r"\. ", 2)[1]))


def match_titles(titles: Column, pool: Column, k: Column) -> Column:
    """For each title the first candidate where one text holds the other; k at most.

    Unmatched titles vanish and a candidate may be matched twice.
    """

    def first_match(title):
        wanted = F.lower(title)
        return F.get(
            F.filter(
                pool,
                lambda c: F.contains(F.lower(c["name"]), wanted) | F.contains(wanted, F.lower(c["name"])),
            ),
            F.lit(0),
        )

    found = F.filter(F.transform(titles, first_match), lambda c: c.isNotNull())
    return F.slice(found, F.lit(1), k)


def fill(matched: Column, pool: Column, k: Column) -> Column:
    """Append unseen candidates in pool order until there are k."""
    seen = F.transform(matched, lambda c: c["item_id"])
    unseen = F.filter(pool, lambda c: ~F.array_contains(seen, c["item_id"]))
    return F.slice(F.concat(matched, unseen), F.lit(1), k)


def rank_scores(chosen: Column) -> Column:
    """Scores by position: the first keeps its own (0.3 at least), each next 3% less.

    An item listed twice carries the score of its last position in both places.
    """
    top = F.greatest(F.get(chosen, F.lit(0))["score"], F.lit(MIN_TOP_SCORE))
    backwards = F.reverse(F.transform(chosen, lambda c: c["item_id"]))

    def rescored(c):
        last = F.size(chosen) - F.array_position(backwards, c["item_id"])
        score = F.least(top * (F.lit(1.0) - last * F.lit(RANK_STEP)), F.lit(MAX_SCORE))
        return c.withField("score", F.bround(score, 4))

    return F.transform(chosen, rescored)


def rerank(pools: DataFrame, responses: DataFrame | None) -> DataFrame:
    """Replace ``pool`` by the ``chosen`` k candidates of each query.

    ``pools``: query_id, k, pool. Queries without an answer keep pool order
    and scores; ``reranked`` tells which were answered.
    """
    if responses is None:
        joined = pools.withColumn("content", F.lit(None).cast("string"))
    else:
        joined = pools.join(responses.select("query_id", "content"), "query_id", "left")
    k, pool = F.col("k"), F.col("pool")
    answered = (
        joined.withColumn("_titles", parse_titles(F.col("content")))
        .withColumn("_matched", match_titles(F.col("_titles"), pool, k))
        .withColumn("_filled", fill(F.col("_matched"), pool, k))
    )
    reranked = F.col("content").isNotNull()
    return answered.withColumn(
        "chosen", F.when(reranked, rank_scores(F.col("_filled"))).otherwise(F.slice(pool, F.lit(1), k))
    ).withColumn("reranked", reranked).drop("_titles", "_matched", "_filled", "content", "pool")


def cut_by_type(chosen: Column, wanted: Column, k: Column) -> Column:
    """Type filter after re-ranking, then the first k."""
    kept = F.filter(
        chosen, lambda c: no_type_filter(wanted) | (F.lower(c["item_type"]) == F.lower(wanted))
    )
    return F.slice(kept, F.lit(1), k)


def unpack(df: DataFrame, chosen: str = "chosen") -> DataFrame:
    """One row per chosen candidate with its new rank."""
    others = [c for c in df.columns if c != chosen]
    rows = df.select(*others, F.posexplode(chosen).alias("_at", "_c"))
    return rows.select(
        *others,
        (F.col("_at") + 1).alias("rank"),
        *[F.col("_c")[c].alias(c) for c in CANDIDATE if c != "rank"],
    )
