"""Registered queries over the test tables, each with its SQL for comparison.

``entry`` runs the flagship query; ``queries`` and ``oracle_sql`` pair every
operator with equivalent SQL. All run over whole tables and whole texts.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from importlib.util import find_spec

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark import cloudpickle  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from rankloom.functions import text as tx  # noqa: E402
from rankloom.functions.tokens import with_terms  # noqa: E402
from rankloom.operators import clean, evaluate, pages, rank, rerank, searchlog, vectors  # noqa: E402
from rankloom.operators import l2_index as l2  # noqa: E402
from rankloom.operators import containment, postings, result_cache, vector_store  # noqa: E402
from rankloom.operators.term_store import TermStore  # noqa: E402
from rankloom.operators.tfidf import TfidfIndex, retrieve  # noqa: E402
from rankloom.operators.topk import nearest  # noqa: E402
from rankloom.plans import catalog as catalog_plan  # noqa: E402
from rankloom.plans import recommend as recommend_plan  # noqa: E402
from rankloom.plans.evaluation import evaluate_dense  # noqa: E402
from rankloom.session import materialise, new_folder  # noqa: E402
from rankloom.sources import export, tables  # noqa: E402
from rankloom.sources import searchlog as log_store  # noqa: E402
from rankloom.sources.frontier import SeenLinks  # noqa: E402
from rankloom.sources.tables import items_from_lists  # noqa: E402

# The stand-in encoder below travels to the tasks by value.
if __name__ in sys.modules:
    cloudpickle.register_pickle_by_value(sys.modules[__name__])

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None, ints: tuple[str, ...] = ()):
    """Register a query under its function name, with its SQL if there is one.

    ``ints`` are columns that are 32 bits wide here and 64 in plain SQL.
    """

    def register(function):
        _QUERIES[function.__name__] = function
        if sql is not None and ints:
            casts = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in ints)
            _ORACLES[function.__name__] = f"SELECT * REPLACE ({casts}) FROM ({sql})"
        elif sql is not None:
            _ORACLES[function.__name__] = sql
        return function

    return register


def entry(spark: SparkSession) -> DataFrame:
    """TF-IDF top 20 documents of every benchmark text."""
    return tfidf_topk(spark, "/root/testdata/sf0.001")


def _training_data():
    """The queries of the optional subpackage and pipeline, where they are there."""
    if find_spec("rankloom.llm") is None or find_spec("corpus_pipeline") is None:
        return {}, {}
    import corpus_pipeline
    from rankloom.llm.queries import ORACLES, QUERIES

    sql = {} if corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL}
    return QUERIES | {"pipeline": corpus_pipeline.run}, ORACLES | sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES | _training_data()[0]


def oracle_sql() -> dict[str, str]:
    return _ORACLES | _training_data()[1]


# --- inputs -----------------------------------------------------------------


def _load(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _dealt_docs(spark, sf, *columns):
    """documents dealt to all cores: the test tables are single files of one row group, which one task would read."""
    return materialise(_load(spark, sf, "documents").select(*columns), tasks=spark.sparkContext.defaultParallelism)


def _raw_catalog(spark, sf):
    """documents as a raw catalog: first sentence as name, text as description."""
    return _load(spark, sf, "documents").select(
        F.col("doc_id").alias("item_id"),
        F.col("doc_id").alias("seq"),
        F.substring_index("text", ".", 1).alias("name"),
        F.col("text").alias("description"),
        F.concat(F.lit("https://x.test/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
    )


def _dealt_catalog(spark, sf):
    return materialise(_raw_catalog(spark, sf), tasks=spark.sparkContext.defaultParallelism)


def _vector_items(spark, sf):
    """embeddings as items: the label is the type."""
    return _load(spark, sf, "embeddings").select(
        F.col("vec_id").alias("item_id"),
        F.col("embedding").alias("vector"),
        F.concat(F.lit("Label"), F.col("label").cast("string")).alias("item_type"),
        F.concat(F.lit('Item "'), F.col("vec_id").cast("string"), F.lit('", no. '), F.col("label").cast("string")).alias("name"),
        F.concat(F.lit("https://x.test/L"), F.col("label").cast("string"), F.lit("/"), F.col("vec_id").cast("string")).alias("url"),
        "label",
    )


def _vector_queries(items):
    """Every vector asks once: mixed type wishes, k by label."""
    wish = (
        F.when(F.col("label") == 0, F.lit("ALL"))
        .when(F.col("label") == 1, F.lit(""))
        .when(F.col("label") == 2, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("lABEL"), ((F.col("label") + 1) % 10).cast("string")))
    )
    return items.select(
        F.col("item_id").alias("query_id"), "vector", wish.alias("query_type"), (F.col("label") + 1).alias("k")
    )


def _event_requests(spark, sf):
    return _load(spark, sf, "events").select(
        F.col("event_id").alias("request_id"),
        F.col("user_id").cast("string").alias("session_id"),
        F.when(F.col("user_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("query"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("type"), (F.col("user_id") % 3).cast("string"))).alias("item_type"),
        F.col("value").alias("query_time_ms"),
        F.col("ts").alias("created_at"),
    )


def _event_searches(spark, sf):
    requests = _event_requests(spark, sf)
    return requests.select(
        F.col("request_id").alias("id"),
        "session_id",
        "query",
        F.col("k").alias("result_count"),
        F.lit("rag").alias("method"),
        "query_time_ms",
        "item_type",
        "created_at",
        (F.col("k") % 2 == 1).alias("cached"),
    )


def _at(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias("created_at")


_SPACE = tx.SPACE
_DOCS_SQL = r"""raw AS (
  SELECT doc_id AS item_id, doc_id AS seq, split_part(text, '.', 1) AS name, text AS description,
         'https://x.test/' || source || '/' || doc_id AS url
  FROM documents)"""


def _collapse_sql(x):
    return f"trim(regexp_replace({x}, '[{_SPACE}]+', ' ', 'g'))"


_NOISE_SQL = "(?i)(?:" + "|".join(tx.NOISE_PHRASES) + ").*"
_CLASSES_SQL = (
    "CASE "
    + " ".join(
        "WHEN " + " OR ".join(f"contains(lower(name), '{w}')" for w in words) + f" THEN '{label}'"
        for label, words in tx.TYPE_RULES
    )
    + f" ELSE '{tx.DEFAULT_TYPE}' END"
)


def _clean_sql(source="raw"):
    """CTEs cleaning a relation with name, description; result ``cleaned``."""
    return f"""c1 AS (SELECT * EXCLUDE (name, description), {_collapse_sql('name')} AS name,
  regexp_replace({_collapse_sql(f"regexp_replace(coalesce(description, '{tx.NO_DESCRIPTION}'), '{_NOISE_SQL}', '', 'g')")},
    'http[^{_SPACE}]+|www\\.[^{_SPACE}]+', '', 'g') AS d FROM {source}),
c2 AS (SELECT * EXCLUDE (d), CASE WHEN length(d) < {tx.SHORT_LIMIT} THEN '{tx.SHORT_DESCRIPTION}' ELSE d END AS description FROM c1),
cleaned AS (SELECT *, {_collapse_sql("name || '. ' || description")} AS embedding_text, {_CLASSES_SQL} AS item_type FROM c2)"""


_ITEMS_SQL = """items AS (
  SELECT vec_id AS item_id, embedding::DOUBLE[] AS v, 'Label' || label AS item_type, label,
         'Item "' || vec_id || '", no. ' || label AS name,
         'https://x.test/L' || label || '/' || vec_id AS url
  FROM embeddings),
asks AS (
  SELECT item_id AS query_id, v, label + 1 AS k,
         CASE label WHEN 0 THEN 'ALL' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE 'lABEL' || ((label + 1) % 10) END AS query_type
  FROM items),
pairs AS (
  SELECT query_id, i.item_id, i.item_type, i.name, i.url, a.k, a.query_type,
         round(list_cosine_similarity(a.v, i.v), 6) AS score
  FROM asks a, items i),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM pairs)"""

_REQUESTS_SQL = """requests AS (
  SELECT event_id AS request_id, CAST(user_id AS VARCHAR) AS session_id,
         CASE WHEN user_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS query,
         CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k,
         CASE WHEN user_id % 3 <> 0 THEN 'type' || (user_id % 3) END AS item_type,
         value AS query_time_ms, ts
  FROM events),
searches AS (
  SELECT request_id AS id, session_id, query, k AS result_count, 'rag' AS method, query_time_ms, item_type, ts,
         k % 2 = 1 AS cached
  FROM requests)"""


# --- cleaning ---------------------------------------------------------------


@query("SELECT doc_id, text, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def dedupe_keep_first(spark, sf):
    docs = _load(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    return rank.keep_first(docs, "text", "doc_id")


@query("SELECT count(*) AS n_rows, count(DISTINCT text) AS n_kept, count(*) - count(DISTINCT text) AS n_removed FROM documents")
def dedupe_counts(spark, sf):
    return clean.duplicates_removed(_load(spark, sf, "documents"), "text")


def _labelled(spark, sf):
    docs, labels = _load(spark, sf, "documents"), _load(spark, sf, "labels")
    joined = docs.join(labels, "doc_id", "left")
    return joined.select(
        "doc_id",
        F.when(F.col("lang") != "fr", F.substring_index("text", ".", 1)).alias("name"),
        F.when(F.col("toxic") == 0, F.col("text")).alias("description"),
        F.when(F.col("quality") == 1, F.col("source")).alias("url"),
    )


_LABELLED_SQL = """labelled AS (
  SELECT d.doc_id, CASE WHEN lang <> 'fr' THEN split_part(text, '.', 1) END AS name,
         CASE WHEN toxic = 0 THEN text END AS description, CASE WHEN quality = 1 THEN source END AS url
  FROM documents d LEFT JOIN labels USING (doc_id))"""


@query(f"""WITH {_LABELLED_SQL}
SELECT count(*) FILTER (name IS NULL) AS name_nulls, count(*) FILTER (description IS NULL) AS description_nulls,
       count(*) FILTER (url IS NULL) AS url_nulls FROM labelled""")
def null_profile(spark, sf):
    return clean.null_profile(_labelled(spark, sf), ["name", "description", "url"])


@query(f"""WITH {_LABELLED_SQL}
SELECT doc_id, name, coalesce(description, '{tx.NO_DESCRIPTION}') AS description, url
FROM labelled WHERE name IS NOT NULL AND url IS NOT NULL""")
def drop_fill(spark, sf):
    return clean.drop_incomplete(_labelled(spark, sf))


@query(f"WITH {_DOCS_SQL}, {_clean_sql()} SELECT item_id, name, description, embedding_text FROM cleaned")
def clean_text(spark, sf):
    return clean.clean_texts(_dealt_catalog(spark, sf)).select("item_id", "name", "description", "embedding_text")


_PART_RULES = [("Fastener", ["bolt", "rod", "ring"]), ("Machine", ["gear", "widget", "gizmo"]), ("Plate", ["plate"])]
_PART_SQL = (
    "CASE "
    + " ".join(
        "WHEN " + " OR ".join(f"contains(lower(p_name), '{w}')" for w in words) + f" THEN '{label}'"
        for label, words in _PART_RULES
    )
    + " ELSE 'General' END"
)


@query(f"SELECT p_partkey, {_PART_SQL} AS part_class FROM part")
def classify(spark, sf):
    part = _load(spark, sf, "part")
    return part.select("p_partkey", tx.classify(F.col("p_name"), _PART_RULES).alias("part_class"))


@query(f"SELECT {_PART_SQL} AS item_type, count(*) AS n FROM part GROUP BY 1")
def type_counts(spark, sf):
    part = _load(spark, sf, "part")
    return clean.type_counts(part.select(tx.classify(F.col("p_name"), _PART_RULES).alias("item_type")))


@query("""SELECT count(*) AS n_items, avg(length(text)) AS avg_length, min(length(text)) AS min_length,
max(length(text)) AS max_length FROM documents""", ints=("min_length", "max_length"))
def text_lengths(spark, sf):
    return clean.text_lengths(_load(spark, sf, "documents"), "text")


@query(f"""WITH {_DOCS_SQL}, {_clean_sql()}
SELECT count(*) AS total_items, count(DISTINCT item_type) AS unique_types, round(avg(length(name)), 6) AS avg_name_length,
  round(avg(length(description)), 6) AS avg_description_length, round(avg(length(embedding_text)), 6) AS avg_embedding_text_length
FROM cleaned""")
def catalog_summary(spark, sf):
    summary = clean.catalog_summary(clean.add_type(clean.clean_texts(_dealt_catalog(spark, sf))))
    return summary.select(*[F.round(c, 6).alias(c) if c.startswith("avg") else F.col(c) for c in summary.columns])


@query(f"""WITH {_DOCS_SQL}, first AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq) = 1), {_clean_sql('first')}
SELECT item_id, name, description, url, embedding_text, item_type FROM cleaned""")
def clean_catalog(spark, sf):
    return clean.clean_catalog(_raw_catalog(spark, sf)).select(
        "item_id", "name", "description", "url", "embedding_text", "item_type"
    )


@query(f"""WITH {_DOCS_SQL}, {_clean_sql()}
SELECT item_id, name || '. ' || embedding_text AS page_content, url AS meta_url, name AS meta_name, item_type AS meta_type FROM cleaned""")
def retrieval_documents(spark, sf):
    docs = clean.retrieval_documents(clean.add_type(clean.clean_texts(_raw_catalog(spark, sf))))
    return docs.select(
        "item_id", "page_content", F.col("metadata.url").alias("meta_url"),
        F.col("metadata.name").alias("meta_name"), F.col("metadata.item_type").alias("meta_type"),
    )


@query(f"""WITH {_DOCS_SQL}, {_clean_sql()}
SELECT item_id, embedding_text AS page_content, name AS meta_name, url AS meta_url FROM cleaned""")
def index_documents(spark, sf):
    docs = clean.index_documents(clean.clean_texts(_raw_catalog(spark, sf)))
    return docs.select(
        "item_id", "page_content", F.col("metadata.name").alias("meta_name"), F.col("metadata.url").alias("meta_url")
    )


@query(f"""WITH {_DOCS_SQL}
SELECT item_id, name, substr(description, 1, 100) AS description, url FROM raw ORDER BY item_id LIMIT 3""")
def preview(spark, sf):
    return rank.preview(_raw_catalog(spark, sf).drop("seq"), "item_id", 3, {"description": 100})


@query("""SELECT doc_id, item_id, line, n FROM (
  SELECT doc_id, generate_subscripts(l, 1) - 1 AS item_id, unnest(l) AS line, length(unnest(l)) AS n
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))""", ints=("n",))
def lists_to_rows(spark, sf):
    lists = _load(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("line"))
    lists = lists.withColumn("n", F.transform("line", lambda s: F.length(s)))
    rows = items_from_lists(lists, ["line", "n"], keep=["doc_id"])
    return rows.select("doc_id", "item_id", "line", "n")


# --- round trips of sources and sinks ---------------------------------------


_CSV_SQL = f"""WITH {_DOCS_SQL} SELECT CASE WHEN item_id % 7 <> 0 THEN name END AS name, description, url FROM raw"""


def _csv_round_trip(spark, sf, one_line):
    raw = _raw_catalog(spark, sf).withColumn("name", F.when(F.col("item_id") % 7 == 0, F.lit("#N/A")).otherwise(F.col("name")))
    path = new_folder(spark, "catalog")
    tables.write_catalog(raw, path, one_line)
    return tables.read_catalog(spark, path, one_line=one_line).select("name", "description", "url")


@query(_CSV_SQL)
def catalog_csv(spark, sf):
    return _csv_round_trip(spark, sf, False)


@query(_CSV_SQL)
def catalog_csv_one_line(spark, sf):
    return _csv_round_trip(spark, sf, True)


@query("SELECT 'like ' || label AS query, 'https://x.test/L' || label || '/' || vec_id AS url FROM embeddings")
def truth_csv(spark, sf):
    items, path = _vector_items(spark, sf), new_folder(spark, "truth")
    rows = items.select(F.concat(F.lit("like "), F.col("label").cast("string")).alias("Query"), F.col("url").alias("Assessment_url"))
    rows.write.option("header", True).csv(path)
    return tables.read_truth(spark, path)


@query("SELECT vec_id AS item_id, 'Label' || label AS item_type, len(embedding) AS size, CAST(embedding[1] AS DOUBLE) AS first FROM embeddings", ints=("size",))
def vectors_round_trip(spark, sf):
    path = new_folder(spark, "vectors")
    tables.write_vectors(_vector_items(spark, sf), path)
    rows = tables.read_vectors(spark, path)
    return rows.select("item_id", "item_type", F.size("vector").alias("size"), F.col("vector")[0].cast("double").alias("first"))


@query("""SELECT 'hash-64' AS model_name, max(len(embedding)) AS embedding_dimension, count(*) AS num_assessments,
'catalog' AS input_file, 'vectors' AS embeddings_file, 'vectors' AS metadata_file FROM embeddings""", ints=("embedding_dimension", "num_assessments"))
def run_config_json(spark, sf):
    path = new_folder(spark, "config")
    tables.write_run_config(run_config(spark, sf), path)
    return tables.read_run_config(spark, path)


@query("""SELECT page_id AS request_id, CASE WHEN page_id % 3 = 0 THEN 36 ELSE 2 END AS n FROM pages""", ints=("n",))
def session_default(spark, sf):
    """A third of the requests has no session and an eighth of these an empty one."""
    given = F.when(F.col("page_id") % 24 == 0, F.lit("")).when(F.col("page_id") % 3 != 0, F.lit("s1"))
    requests = _load(spark, sf, "pages").select("page_id", given.alias("session_id"))
    return requests.select(F.col("page_id").alias("request_id"), F.length(tx.session_or_new(F.col("session_id"))).alias("n"))


# --- TF-IDF -----------------------------------------------------------------

_WORDS = r"regexp_extract_all(lower(coalesce({text}, '')), '[\p{{L}}\p{{N}}_]{{2,}}')"


def _terms_sql(relation, key, text, out):
    """CTEs counting the words and word pairs of each text: ``out`` (key, term, tf)."""
    return f"""{out}_w AS (SELECT {key} AS key, unnest(l) AS w, generate_subscripts(l, 1) AS i
  FROM (SELECT {key}, {_WORDS.format(text=text)} AS l FROM {relation})),
{out} AS (SELECT key, term, count(*) AS tf FROM (
    SELECT key, w AS term FROM {out}_w
    UNION ALL
    SELECT key, w || ' ' || n FROM (SELECT key, w, lead(w) OVER (PARTITION BY key ORDER BY i) AS n FROM {out}_w) WHERE n IS NOT NULL)
  GROUP BY key, term)"""


def _fit_sql(relation, key, text):
    """CTEs ``vocab`` (term, total, df, idf) and ``dw`` (key, term, w)."""
    return f"""{_terms_sql(relation, key, text, 'dt')},
vocab AS (SELECT *, ln((1.0 + (SELECT count(*) FROM {relation})) / (1.0 + df)) + 1.0 AS idf FROM (
    SELECT term, CAST(sum(tf) AS BIGINT) AS total, count(*) AS df FROM dt GROUP BY term ORDER BY total DESC, term LIMIT 8000)),
dw AS (SELECT key, term, x / sqrt(sum(x * x) OVER (PARTITION BY key)) AS w
  FROM (SELECT key, term, tf * idf AS x FROM dt JOIN vocab USING (term)))"""


_QUERY_SQL = f"""{_terms_sql('benchmark', 'item_id', 'text', 'qt')},
qw AS (SELECT key, term, x / sqrt(sum(x * x) OVER (PARTITION BY key)) AS w
  FROM (SELECT key, term, tf * idf AS x FROM qt JOIN vocab USING (term)))"""


@query(r"SELECT doc_id, len(l) AS n_words, coalesce(l[1], '') AS first_word, coalesce(l[-1], '') AS last_word FROM (SELECT doc_id, "
       + _WORDS.format(text="text") + " AS l FROM documents)", ints=("n_words",))
def tokenise(spark, sf):
    terms = with_terms(_load(spark, sf, "documents").select("doc_id", "text"), "text")
    words = ((F.size("terms") + 1) / 2).cast("int")
    first = F.coalesce(F.get("terms", F.lit(0)), F.lit(""))
    last = F.when(words > 0, F.get("terms", words - 1)).otherwise(F.lit(""))
    return terms.select("doc_id", words.alias("n_words"), first.alias("first_word"), last.alias("last_word"))


@query(f"WITH {_fit_sql('documents', 'doc_id', 'text')} SELECT term, total, df, round(idf, 6) AS idf FROM vocab")
def tfidf_vocab(spark, sf):
    index = TfidfIndex.fit(_dealt_docs(spark, sf, "text"), "text")
    return index.frame(spark).select("term", "total", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_fit_sql('documents', 'doc_id', 'text')} SELECT term, total, df, round(idf, 6) AS idf FROM vocab")
def tfidf_saved(spark, sf):
    """The vocabulary fitted once, saved and loaded."""
    path = new_folder(spark, "vocabulary")
    TfidfIndex.fit(_load(spark, sf, "documents").select("text"), "text").save(spark, path)
    return TfidfIndex.load(spark, path).frame(spark).select("term", "total", "df", F.round("idf", 6).alias("idf"))


@query(_ORACLES["tfidf_vocab"])
def tfidf_refit(spark, sf):
    """The vocabulary from the stored counts of two batches."""
    docs, store = _dealt_docs(spark, sf, "doc_id", "text"), TermStore(spark, new_folder(spark, "terms"))
    for number in range(2):
        store.add(docs.where(F.col("doc_id") % 2 == number), "text", number)
    return store.fit().frame(spark).select("term", "total", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_LABELLED_SQL} SELECT doc_id, len(l) AS n_words FROM (SELECT doc_id, {_WORDS.format(text='description')} AS l FROM labelled)", ints=("n_words",))
def tokenise_nulls(spark, sf):
    terms = with_terms(_labelled(spark, sf).select("doc_id", "description"), "description")
    return terms.select("doc_id", ((F.size("terms") + 1) / 2).cast("int").alias("n_words"))


@query(f"WITH {_fit_sql('documents', 'doc_id', 'text')} SELECT key AS doc_id, term, round(w, 6) AS weight FROM dw")
def tfidf_weights(spark, sf):
    docs = _dealt_docs(spark, sf, "doc_id", "text")
    weights = TfidfIndex.fit(docs, "text").weights(docs, "doc_id")
    return weights.select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query(f"""WITH {_fit_sql('documents', 'doc_id', 'text')}, {_QUERY_SQL},
dots AS (SELECT q.key AS query_id, d.key AS item_id, sum(q.w * d.w) AS s FROM qw q JOIN dw d USING (term) GROUP BY 1, 2)
SELECT b.item_id AS query_id, d.doc_id AS item_id, d.source AS item_type, round(coalesce(s, 0), 6) AS score,
       row_number() OVER (PARTITION BY b.item_id ORDER BY round(coalesce(s, 0), 6) DESC, d.doc_id) AS rank
FROM benchmark b CROSS JOIN documents d LEFT JOIN dots ON dots.query_id = b.item_id AND dots.item_id = d.doc_id
QUALIFY rank <= 20""", ints=("rank",))
def tfidf_topk(spark, sf):
    docs = _dealt_docs(spark, sf, F.col("doc_id").alias("item_id"), "text", F.col("source").alias("item_type"))
    index = TfidfIndex.fit(docs, "text")
    asked = _load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    found = retrieve(index, index.transform(docs), asked, 20, payload=["item_type"], decimals=6)
    return found.select("query_id", "item_id", "item_type", F.round("score", 6).alias("score"), "rank")


@query(_ORACLES["tfidf_topk"])
def tfidf_index_topk(spark, sf):
    """The same search through an inverted index that is built, stored and read by term."""
    docs = _load(spark, sf, "documents").select(
        F.col("doc_id").alias("item_id"), "text", F.col("source").alias("item_type")
    )
    index, path = TfidfIndex.fit(docs, "text"), new_folder(spark, "postings")
    postings.build(index.transform(docs).where(F.col("item_type").isNotNull()).drop("text"), path)
    asked = _load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    found = postings.PostingIndex(spark, path).search(index.transform(asked, "query"), 20, payload=["item_type"], decimals=6)
    return found.select("query_id", "item_id", "item_type", F.round("score", 6).alias("score"), "rank")


# --- dense vectors and ranking ----------------------------------------------


@query(f"WITH {_ITEMS_SQL} SELECT query_id, item_id, name, score, rank FROM ranked WHERE rank <= 10", ints=("rank",))
def dense_topk(spark, sf):
    items = _vector_items(spark, sf)
    asked = _vector_queries(items).select("query_id", "vector")
    found = vectors.recommend_dense(items, asked, 10, decimals=6)
    return found.select("query_id", "item_id", "name", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {_ITEMS_SQL}
SELECT query_id, item_id, item_type, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank
FROM pairs WHERE coalesce(query_type, '') IN ('', 'ALL') OR lower(query_type) = lower(item_type)
QUALIFY rank <= k""", ints=("rank",))
def type_filter_topk(spark, sf):
    items = _vector_items(spark, sf)
    found = vectors.recommend_dense(items, _vector_queries(items), 10, decimals=6)
    return found.select("query_id", "item_id", "item_type", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {_ITEMS_SQL}
SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank
FROM pairs WHERE item_type NOT IN ('Label0', 'Label3', 'Label6', 'Label9') QUALIFY rank <= 5""", ints=("rank",))
def untyped_left_out(spark, sf):
    items = _vector_items(spark, sf)
    some = items.withColumn("item_type", F.when(F.col("label") % 3 != 0, F.col("item_type")))
    found = vectors.recommend_dense(some, _vector_queries(items).select("query_id", "vector"), 5, decimals=6)
    return found.select("query_id", "item_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {_ITEMS_SQL}, cut AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS new_rank FROM ranked
  WHERE rank <= 20 AND rank <= 2 * k AND (coalesce(query_type, '') IN ('', 'ALL') OR lower(query_type) = lower(item_type)))
SELECT query_id, item_id, item_type, score, new_rank AS rank FROM cut WHERE new_rank <= k""", ints=("rank",))
def overfetch_filter(spark, sf):
    items = _vector_items(spark, sf)
    asked = _vector_queries(items)
    pool = nearest(items, asked.select("query_id", "vector"), 20, payload=["item_type"], decimals=6)
    return rank.overfetch(pool, asked).select(
        "query_id", "item_id", "item_type", F.round("score", 6).alias("score"), "rank"
    )


@query("""SELECT vec_id AS item_id, label FROM embeddings ORDER BY md5(CAST(vec_id AS VARCHAR) || ':42'), vec_id LIMIT 3""")
def sample_items(spark, sf):
    return vectors.sample_items(_vector_items(spark, sf), 3).select("item_id", "label")


@query(f"""WITH {_ITEMS_SQL}
SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank
FROM pairs WHERE item_id <> query_id QUALIFY rank <= 5""", ints=("rank",))
def neighbours(spark, sf):
    items = _vector_items(spark, sf)
    found = vectors.neighbours(items, items, 5, decimals=6)
    return found.select("query_id", "item_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {_ITEMS_SQL}, chosen AS (SELECT item_id FROM items ORDER BY md5(CAST(item_id AS VARCHAR) || ':42'), item_id LIMIT 3)
SELECT query_id, item_id, name, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank
FROM pairs WHERE item_id <> query_id AND query_id IN (SELECT item_id FROM chosen) QUALIFY rank <= 5""", ints=("rank",))
def sampled_neighbours(spark, sf):
    items = _vector_items(spark, sf)
    found = vectors.neighbours(items, vectors.sample_items(items, 3), 5, payload=["name"], decimals=6)
    return found.select("query_id", "item_id", "name", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {_ITEMS_SQL}, d AS (SELECT a.query_id, i.item_id,
    round(list_sum(list_transform(list_zip(a.v, i.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS distance FROM asks a, items i)
SELECT query_id, item_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS rank
FROM d QUALIFY rank <= 5""", ints=("rank",))
def l2_knn(spark, sf):
    items = _vector_items(spark, sf)
    asked = _vector_queries(items).select("query_id", "vector")
    found = vectors.l2_nearest(items, asked, 5, decimals=6)
    return found.select("query_id", "item_id", F.round("distance", 6).alias("distance"), "rank")


def _scaled_knn(spark, sf, factor):
    """Exact search among vectors of another scale; distances are given in its unit."""
    scaled = F.transform("vector", lambda x: x.cast("double") * F.lit(factor))
    items = _vector_items(spark, sf).withColumn("vector", scaled)
    asked = _vector_queries(items).select("query_id", "vector")
    found = vectors.l2_nearest(items, asked, 5)
    return found.select("query_id", "item_id", F.round(F.col("distance") / factor / factor, 6).alias("distance"), "rank")


_SCALED_SQL = f"""WITH {_ITEMS_SQL}, d AS (SELECT a.query_id, i.item_id,
    list_sum(list_transform(list_zip(a.v, i.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS exact FROM asks a, items i)
SELECT query_id, item_id, round(exact, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY exact, item_id) AS rank
FROM d QUALIFY rank <= 5"""


@query(_SCALED_SQL, ints=("rank",))
def l2_knn_large(spark, sf):
    return _scaled_knn(spark, sf, 1e7)


@query(_SCALED_SQL, ints=("rank",))
def l2_knn_small(spark, sf):
    return _scaled_knn(spark, sf, 1e-5)


def _indexed_knn(spark, sf, factor):
    """The nearest five from an index that is built, stored and loaded."""
    items = _vector_items(spark, sf).withColumn("vector", F.transform("vector", lambda x: x.cast("double") * F.lit(factor)))
    path = new_folder(spark, "index")
    l2.build(items.select("item_id", "vector"), path)
    asked = _vector_queries(items).select("query_id", "vector")
    found = l2.L2Index.load(spark, path).search(asked, 5, decimals=6 if factor == 1.0 else None)
    return found.select("query_id", "item_id", F.round(F.col("distance") / factor / factor, 6).alias("distance"), "rank")


@query(f"""WITH {_ITEMS_SQL}, d AS (SELECT a.query_id, i.item_id,
    round(list_sum(list_transform(list_zip(a.v, i.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS distance FROM asks a, items i)
SELECT query_id, item_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS rank
FROM d QUALIFY rank <= 5""", ints=("rank",))
def l2_index_knn(spark, sf):
    return _indexed_knn(spark, sf, 1.0)


@query(_SCALED_SQL, ints=("rank",))
def l2_index_knn_large(spark, sf):
    return _indexed_knn(spark, sf, 1e7)


@query(f"WITH {_ITEMS_SQL} SELECT query_id, item_id, name, score, rank FROM ranked WHERE rank <= 10", ints=("rank",))
def dense_topk_blocks(spark, sf):
    """The same search with the queries in several blocks, as a table beyond one block's bounds has."""
    items = _vector_items(spark, sf)
    asked = _vector_queries(items).select("query_id", "vector")
    found = nearest(items, asked, 10, payload=["name"], decimals=6, block_rows=200)
    return found.select("query_id", "item_id", "name", F.round("score", 6).alias("score"), "rank")


@query("SELECT count(*) AS n_rows, max(len(embedding)) AS dimension, sum(len(embedding)) * 4 / 1048576.0 AS size_mb FROM embeddings", ints=("dimension",))
def vector_stats(spark, sf):
    return vectors.vector_stats(_vector_items(spark, sf))


@query("""SELECT 'hash-64' AS model_name, max(len(embedding)) AS embedding_dimension, count(*) AS num_assessments,
'catalog' AS input_file, 'vectors' AS embeddings_file, 'vectors' AS metadata_file FROM embeddings""", ints=("embedding_dimension",))
def run_config(spark, sf):
    return vectors.run_config(_vector_items(spark, sf), "hash-64", "catalog", "vectors", "vectors")


_LETTERS = "aeinrst"


def _letter_encoder():
    """A stand-in encoder: how often each of seven letters occurs."""
    import numpy as np

    return lambda texts: np.array([[t.count(c) for c in _LETTERS] for t in texts], dtype=np.float32)


def _letters_sql(text):
    return ", ".join(f"CAST(length({text}) - length(replace({text}, '{c}', '')) AS DOUBLE)" for c in _LETTERS)


@query("SELECT doc_id, " + ", ".join(
    f"CAST(length(text) - length(replace(text, '{c}', '')) AS DOUBLE) AS n_{c}" for c in _LETTERS) + " FROM documents")
def encode(spark, sf):
    docs = _load(spark, sf, "documents").select("doc_id", "text")
    encoded = vectors.encode(docs, "text", _letter_encoder)
    return encoded.select(
        "doc_id", *[F.col("vector")[i].cast("double").alias(f"n_{c}") for i, c in enumerate(_LETTERS)]
    )


@query(_ORACLES["encode"])
def encode_stored(spark, sf):
    """The same vectors from a store that had those of every other document before."""
    docs, path = _load(spark, sf, "documents").select("doc_id", "text"), new_folder(spark, "vectors")
    vector_store.add_missing(docs.where("doc_id % 2 = 0"), "text", _letter_encoder, path)
    encoded = vector_store.encode_stored(docs, "text", _letter_encoder, path)
    return encoded.select(
        "doc_id", *[F.col("vector")[i].cast("double").alias(f"n_{c}") for i, c in enumerate(_LETTERS)]
    )


@query("""WITH titles AS (SELECT DISTINCT lower(t) AS title FROM (SELECT unnest([split_part(p_name, ' ', 2), p_name || ' kit', left(p_name, 2), p_type]) AS t FROM part)
  WHERE t <> ''),
names AS (SELECT lower(p_name) AS name, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1)
SELECT title, CAST(sum(n) AS BIGINT) AS n_items, min(first) AS first_item FROM titles, names
WHERE contains(name, title) OR contains(title, name) GROUP BY title""")
def title_containment(spark, sf):
    """Titles against all part names: words, beginnings and longer forms of these, and types."""
    part = _load(spark, sf, "part")
    forms = F.array(F.split_part("p_name", F.lit(" "), F.lit(2)), F.concat("p_name", F.lit(" kit")), F.left("p_name", F.lit(2)), F.col("p_type"))
    items = part.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"))
    return containment.items_of_titles(part.select(F.explode(forms).alias("title")), items)


@query(f"""WITH d AS (SELECT doc_id, source, [{_letters_sql('text')}] AS v FROM documents),
b AS (SELECT item_id, [{_letters_sql('text')}] AS v FROM benchmark)
SELECT b.item_id AS query_id, doc_id AS item_id, 'Document ' || doc_id AS name, source AS item_type,
  round(coalesce(nullif(list_cosine_similarity(b.v, d.v), 'nan'::DOUBLE), 0), 6) AS score,
  row_number() OVER (PARTITION BY b.item_id ORDER BY
    round(coalesce(nullif(list_cosine_similarity(b.v, d.v), 'nan'::DOUBLE), 0), 6) DESC, doc_id) AS rank
FROM b, d QUALIFY rank <= 5""", ints=("rank",))
def text_search(spark, sf):
    docs = _load(spark, sf, "documents").select(
        F.col("doc_id").alias("item_id"), "text", F.concat(F.lit("Document "), "doc_id").alias("name"),
        F.col("source").alias("item_type"), F.concat(F.lit("https://x.test/"), "doc_id").alias("url"),
    )
    items = vectors.encode(docs, "text", _letter_encoder)
    asked = _load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    found = vectors.text_search(items, asked, _letter_encoder, 5, decimals=6)
    return found.select("query_id", "item_id", "name", "item_type", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {_REQUESTS_SQL}
SELECT query, k, item_type, min(request_id) AS query_id, count(*) AS n_requests FROM requests GROUP BY query, k, item_type""")
def distinct_requests(spark, sf):
    return rank.distinct_requests(_event_requests(spark, sf))


@query(f"""WITH {_REQUESTS_SQL}, f AS (SELECT *, min(request_id) OVER (PARTITION BY query, k, item_type) AS query_id FROM requests)
SELECT request_id, query, query_id, request_id <> query_id AS cached FROM f""")
def request_dedupe(spark, sf):
    requests = _event_requests(spark, sf)
    tagged = rank.attach_representative(requests, rank.distinct_requests(requests))
    return tagged.select("request_id", "query", "query_id", "cached")


def _cached_batches(spark, sf):
    """(batch, answers, store before, store after): even requests, then odd ones, through a store of 1000 keys."""
    requests = _event_requests(spark, sf).select("request_id", "query", "k", "item_type")
    store = None
    for batch in (0, 1):
        answer = F.concat(F.upper("query"), F.lit(":"), F.coalesce(F.col("k").cast("string"), F.lit("-"))).alias("answer")
        answers, after = result_cache.serve(requests.where(F.col("request_id") % 2 == batch), store, lambda new: new.select("query_id", answer), batch)
        yield batch, answers, store, after
        store = after


_CACHE_SQL = f"""{_REQUESTS_SQL}, r AS (SELECT request_id, query, k, item_type, request_id % 2 AS batch FROM requests),
keys AS (SELECT batch, query, k, item_type, min(request_id) AS query_id FROM r GROUP BY ALL),
store AS (SELECT * FROM keys WHERE batch = 0 ORDER BY query_id DESC LIMIT 1000),
known AS (SELECT q.*, s.query_id IS NOT NULL AS found FROM keys q LEFT JOIN store s
  ON q.batch = 1 AND q.query IS NOT DISTINCT FROM s.query AND q.k IS NOT DISTINCT FROM s.k AND q.item_type IS NOT DISTINCT FROM s.item_type),
answers AS (SELECT r.batch, r.request_id, n.query_id, CASE WHEN found THEN 'stored' WHEN r.request_id = n.query_id THEN 'computed' ELSE 'repeat' END AS status,
  upper(r.query) || ':' || coalesce(CAST(r.k AS VARCHAR), '-') AS answer
  FROM r JOIN known n ON r.batch = n.batch AND r.query IS NOT DISTINCT FROM n.query AND r.k IS NOT DISTINCT FROM n.k AND r.item_type IS NOT DISTINCT FROM n.item_type)"""


@query(f"WITH {_CACHE_SQL} SELECT * FROM answers")
def cache_two_batches(spark, sf):
    """Every request of two batches with its answer and whether it came from the store."""
    found = None
    for batch, answers, _, _ in _cached_batches(spark, sf):
        part = answers.select(F.lit(batch).cast("long").alias("batch"), "request_id", "query_id", "status", "answer")
        found = part if found is None else found.unionByName(part)
    return found


@query(f"""WITH {_CACHE_SQL}, n AS (SELECT batch, count(*) AS requests, count(*) FILTER (status = 'stored') AS stored,
  count(*) FILTER (status = 'repeat') AS repeat, count(*) FILTER (status = 'computed') AS computed FROM answers GROUP BY batch)
SELECT n.*, CAST(CASE WHEN n.batch = 0 THEN greatest(0, n.computed - 1000)
  ELSE greatest(0, least(1000, (SELECT computed FROM n WHERE batch = 0)) + n.computed - 1000) END AS BIGINT) AS evicted FROM n""")
def cache_counts(spark, sf):
    """Hits, misses and evictions of the two batches."""
    found = None
    for batch, answers, before, after in _cached_batches(spark, sf):
        part = result_cache.counts(answers, before, after, batch)
        found = part if found is None else found.unionByName(part)
    return found


@query(f"""WITH {_ITEMS_SQL}, typed AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS r FROM pairs
  WHERE coalesce(query_type, '') IN ('', 'ALL') OR lower(query_type) = lower(item_type)),
failed AS (SELECT query_id FROM asks WHERE k = 4),
both_ways AS (
  SELECT query_id, item_id, r AS rank, score, 'rag' AS method FROM typed WHERE r <= 3 AND query_id NOT IN (SELECT query_id FROM failed)
  UNION ALL
  SELECT query_id, item_id, rank, score, 'semantic' FROM ranked WHERE rank <= 3 AND query_id IN (SELECT query_id FROM failed))
SELECT query_id, item_id, rank, score, CASE WHEN rank = 1 THEN method END AS method FROM both_ways""", ints=("rank",))
def fallback_union(spark, sf):
    items = _vector_items(spark, sf)
    asked = _vector_queries(items)
    typed = vectors.recommend_dense(items, asked.drop("k"), 3, decimals=6)
    plain = vectors.recommend_dense(items, asked.select("query_id", "vector"), 3, decimals=6)
    failed = asked.where(F.col("k") == 4)
    both = rank.tag_first(rank.with_fallback(typed, plain, failed))
    return both.select("query_id", "item_id", "rank", F.round("score", 6).alias("score"), "method")


@query(f"""WITH {_ITEMS_SQL} SELECT query_id, count(*) FILTER (item_type = 'Label3') AS shown, count(*) AS total
FROM ranked WHERE rank <= 10 GROUP BY query_id""")
def shown_of_total(spark, sf):
    items = _vector_items(spark, sf)
    found = vectors.recommend_dense(items, _vector_queries(items).select("query_id", "vector"), 10, decimals=6)
    return rank.shown_of_total(found, "Label3")


@query("""SELECT d.doc_id, coalesce(CASE WHEN lang <> 'fr' THEN lang END, 'Unknown') AS name,
  coalesce(CASE WHEN quality = 1 THEN source END, '') AS url,
  coalesce(CASE WHEN toxic = 0 THEN d.doc_id / 8.0 END, 0.0)::DOUBLE AS score,
  coalesce(CASE WHEN n_chars > 500 THEN source END, 'General') AS item_type
FROM documents d LEFT JOIN labels USING (doc_id)""")
def result_defaults(spark, sf):
    rows = _load(spark, sf, "documents").join(_load(spark, sf, "labels"), "doc_id", "left")
    score = F.when(F.col("toxic") == 0, (F.col("doc_id") / 8.0).cast("string")).when(F.col("toxic") == 1, F.lit("n/a"))
    return rank.result_defaults(
        rows.select(
            "doc_id",
            F.when(F.col("lang") != "fr", F.col("lang")).alias("name"),
            F.when(F.col("quality") == 1, F.col("source")).alias("url"),
            score.alias("score"),
            F.when(F.col("n_chars") > 500, F.col("source")).alias("item_type"),
        )
    )


@query(f"""WITH {_ITEMS_SQL} SELECT query_id, item_id,
CASE WHEN score >= 0.75 THEN 'Excellent Match' WHEN score >= 0.60 THEN 'Good Match' ELSE 'Fair Match' END AS label,
CAST(floor(score * 100 + 0.5) AS BIGINT) AS percent FROM ranked WHERE rank <= 10""")
def match_label(spark, sf):
    found = dense_topk(spark, sf)
    return found.select(
        "query_id", "item_id", tx.match_label(F.col("score")).alias("label"), tx.match_percent(F.col("score")).alias("percent")
    )


@query(rf"""WITH t AS (SELECT conv_id, turn, text, length(regexp_replace(text, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')) AS n FROM conversations)
SELECT conv_id, turn, CASE WHEN n = 0 THEN 'empty' WHEN n < 20 THEN 'too_short' ELSE 'ok' END AS status,
  length(text) > 0 AND length(text) < 50 AS warning, length(text) AS n_chars FROM t""", ints=("n_chars",))
def validate_query(spark, sf):
    text = F.col("text")
    return _load(spark, sf, "conversations").select(
        "conv_id", "turn", tx.query_status(text).alias("status"), tx.query_warning(text).alias("warning"),
        F.length(text).alias("n_chars"),
    )


# --- re-ranking -------------------------------------------------------------


def _pools(spark, sf):
    """Each brand asks for its dearest 20 parts."""
    part = _load(spark, sf, "part").select(
        F.regexp_extract("p_brand", r"(\d+)", 1).cast("long").alias("query_id"),
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("name"),
        F.concat(F.lit("https://x.test/"), F.col("p_partkey").cast("string")).alias("url"),
        F.col("p_type").alias("item_type"),
        F.round(F.col("p_retailprice") / 5000, 4).alias("score"),
    )
    ranked = rank.top_rows(part, ["query_id"], [F.col("score").desc(), F.col("item_id")], 20)
    return rerank.pack_pool(ranked).select(
        "query_id",
        F.concat(F.lit("brand "), F.col("query_id").cast("string")).alias("query"),
        (F.col("query_id") % 3 + 5).cast("int").alias("k"),
        "pool",
    )


def _answers(pools):
    """A made-up answer per pool; every fifth brand gets none."""
    name = lambda i: F.coalesce(F.get("pool", F.lit(i))["name"], F.lit(""))
    content = F.concat(
        F.lit("Here are my picks\n1. "), F.upper(name(6)), F.lit("\n2. the "), name(2), F.lit(" kit\n - 9. skipped\n3. "),
        name(6), F.lit("\n4. no such thing\n5. "), F.substring(name(10), 1, 5), F.lit("\n"),
    )
    return pools.where(F.col("query_id") % 5 != 0).select("query_id", content.alias("content"))


_POOLS_SQL = r"""pool AS (
  SELECT CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS query_id, p_partkey AS item_id, p_name AS name, p_type AS item_type,
         round(p_retailprice / 5000, 4) AS score,
         row_number() OVER (PARTITION BY p_brand ORDER BY round(p_retailprice / 5000, 4) DESC, p_partkey) AS rank
  FROM part QUALIFY rank <= 20),
ks AS (SELECT DISTINCT query_id, CAST(query_id % 3 + 5 AS INTEGER) AS k FROM pool),
named AS (SELECT query_id, coalesce(max(name) FILTER (rank = 7), '') AS n6, coalesce(max(name) FILTER (rank = 3), '') AS n2,
    coalesce(max(name) FILTER (rank = 11), '') AS n10
  FROM pool GROUP BY query_id),
answers AS (SELECT query_id, 'Here are my picks' || chr(10) || '1. ' || upper(n6) || chr(10) || '2. the ' || n2 || ' kit' || chr(10)
    || ' - 9. skipped' || chr(10) || '3. ' || n6 || chr(10) || '4. no such thing' || chr(10) || '5. ' || substr(n10, 1, 5) || chr(10) AS content
  FROM named WHERE query_id % 5 <> 0),
lines AS (SELECT query_id, unnest(l) AS line, generate_subscripts(l, 1) AS i
  FROM (SELECT query_id, string_split(trim(content, chr(10) || ' '), chr(10)) AS l FROM answers)),
titles AS (SELECT query_id, trim(substr(line, strpos(line, '. ') + 2)) AS title,
    row_number() OVER (PARTITION BY query_id ORDER BY i) AS at
  FROM lines WHERE regexp_matches(line, '^[0-9]') AND contains(line, '. ')),
hits AS (SELECT t.query_id, t.at, min(p.rank) AS pool_rank FROM titles t JOIN pool p ON p.query_id = t.query_id
    AND (contains(lower(p.name), lower(t.title)) OR contains(lower(t.title), lower(p.name))) GROUP BY 1, 2),
matched AS (SELECT h.query_id, h.pool_rank, row_number() OVER (PARTITION BY h.query_id ORDER BY h.at) AS pos FROM hits h
  JOIN ks USING (query_id) QUALIFY pos <= any_value(k) OVER (PARTITION BY h.query_id)),
filled AS (SELECT query_id, pool_rank, pos FROM matched
  UNION ALL
  SELECT p.query_id, p.rank, coalesce((SELECT count(*) FROM matched m WHERE m.query_id = p.query_id), 0)
         + row_number() OVER (PARTITION BY p.query_id ORDER BY p.rank)
  FROM pool p WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.query_id = p.query_id AND m.pool_rank = p.rank)),
cut AS (SELECT f.*, p.item_id, p.name, p.score FROM filled f JOIN ks USING (query_id)
  JOIN pool p ON p.query_id = f.query_id AND p.rank = f.pool_rank WHERE pos <= k),
scored AS (SELECT query_id, item_id, name, pos AS rank,
    round(least(greatest(first_value(score) OVER (PARTITION BY query_id ORDER BY pos), 0.3)
      * (1.0 - 0.03 * (max(pos) OVER (PARTITION BY query_id, item_id) - 1)), 0.99), 4) AS score
  FROM cut)"""


@query(f"""WITH {_POOLS_SQL} SELECT query_id, '{rerank.PROMPT_HEAD}' || 'brand ' || query_id || '{rerank.PROMPT_CANDIDATES}'
  || string_agg(rank || '. ' || name, chr(10) ORDER BY rank) || '{rerank.PROMPT_SELECT}' || any_value(k) || '{rerank.PROMPT_TAIL}' AS prompt
FROM pool JOIN ks USING (query_id) GROUP BY query_id""")
def build_prompt(spark, sf):
    return rerank.build_prompts(_pools(spark, sf)).select("query_id", "prompt")


@query(f"WITH {_POOLS_SQL} SELECT query_id, titles.at AS pos, title FROM titles", ints=("pos",))
def rerank_parse(spark, sf):
    titles = _answers(_pools(spark, sf)).select("query_id", rerank.parse_titles(F.col("content")).alias("t"))
    return titles.select("query_id", F.posexplode("t").alias("at", "title")).select(
        "query_id", (F.col("at") + 1).alias("pos"), "title"
    )


def _matched(spark, sf):
    pools = _pools(spark, sf)
    joined = pools.join(_answers(pools), "query_id")
    titles = rerank.parse_titles(F.col("content"))
    return joined.withColumn("matched", rerank.match_titles(titles, F.col("pool"), F.col("k")))


@query(f"""WITH {_POOLS_SQL} SELECT m.query_id, p.item_id, CAST(m.pos AS INTEGER) AS rank FROM matched m
JOIN pool p ON p.query_id = m.query_id AND p.rank = m.pool_rank""")
def rerank_match(spark, sf):
    rows = _matched(spark, sf).select("query_id", "matched")
    return rerank.unpack(rows, "matched").select("query_id", "item_id", "rank")


@query(f"WITH {_POOLS_SQL} SELECT query_id, item_id, CAST(pos AS INTEGER) AS rank FROM cut WHERE query_id IN (SELECT query_id FROM answers)")
def rerank_fill(spark, sf):
    rows = _matched(spark, sf).select(
        "query_id", rerank.fill(F.col("matched"), F.col("pool"), F.col("k")).alias("filled")
    )
    return rerank.unpack(rows, "filled").select("query_id", "item_id", "rank")


@query(f"""WITH {_POOLS_SQL}
SELECT query_id, item_id, name, CAST(rank AS INTEGER) AS rank, score, true AS reranked FROM scored
WHERE query_id IN (SELECT query_id FROM answers)
UNION ALL
SELECT query_id, item_id, name, CAST(rank AS INTEGER), score, false FROM pool JOIN ks USING (query_id)
WHERE rank <= k AND query_id NOT IN (SELECT query_id FROM answers)""")
def rerank_score(spark, sf):
    pools = _pools(spark, sf)
    done = rerank.unpack(rerank.rerank(pools, _answers(pools)))
    return done.select("query_id", "item_id", "name", "rank", "score", "reranked")


@query(f"""WITH {_DOCS_SQL}, {_clean_sql()}, {_fit_sql('cleaned', 'item_id', 'embedding_text')}, {_QUERY_SQL},
dots AS (SELECT q.key AS query_id, d.key AS item_id, sum(q.w * d.w) AS s FROM qw q JOIN dw d USING (term) GROUP BY 1, 2),
pool AS (SELECT b.item_id AS query_id, c.item_id, c.name, c.url, c.item_type, round(coalesce(s, 0), 6) AS score,
    row_number() OVER (PARTITION BY b.item_id ORDER BY round(coalesce(s, 0), 6) DESC, c.item_id) AS rank
  FROM benchmark b CROSS JOIN cleaned c LEFT JOIN dots ON dots.query_id = b.item_id AND dots.item_id = c.item_id QUALIFY rank <= 20),
reqs AS (SELECT item_id AS query_id, CAST(item_id % 12 + 1 AS INTEGER) AS k, CASE WHEN item_id % 2 = 0 THEN 'gENERAL' END AS t FROM benchmark),
kept AS (SELECT p.*, k, row_number() OVER (PARTITION BY p.query_id ORDER BY p.rank) AS r FROM pool p JOIN reqs USING (query_id)
  WHERE p.rank <= 2 * k AND (t IS NULL OR lower(t) = lower(item_type)))
SELECT query_id AS request_id, item_id, name, url, item_type, score, CAST(r AS INTEGER) AS rank,
  CASE WHEN r = 1 THEN 'rag' END AS method FROM kept WHERE r <= k""")
def recommend_batch(spark, sf):
    catalog = clean.clean_catalog(_raw_catalog(spark, sf))
    index, items = catalog_plan.fit_catalog(catalog)
    requests = _load(spark, sf, "benchmark").select(
        F.col("item_id").alias("request_id"),
        F.col("text").alias("query"),
        (F.col("item_id") % 12 + 1).cast("int").alias("k"),
        F.when(F.col("item_id") % 2 == 0, F.lit("gENERAL")).alias("item_type"),
        F.lit(None).cast("string").alias("session_id"),
    )
    answers = recommend_plan.answer(recommend_plan.prepare_requests(requests), index, items, decimals=6)
    found = rank.tag_first(recommend_plan.results(answers))
    return found.select(
        "request_id", "item_id", "name", "url", "item_type", F.round("score", 6).alias("score"), "rank", "method"
    )


_FLOW_SQL = f"""WITH {_DOCS_SQL}, {_clean_sql()}, {_fit_sql('cleaned', 'item_id', 'embedding_text')}, {_QUERY_SQL},
dots AS (SELECT q.key AS query_id, d.key AS item_id, sum(q.w * d.w) AS s FROM qw q JOIN dw d USING (term) GROUP BY 1, 2),
pool AS (SELECT b.item_id AS query_id, c.item_id, c.name, c.item_type, coalesce(s, 0) AS score,
    row_number() OVER (PARTITION BY b.item_id ORDER BY round(coalesce(s, 0), 6) DESC, c.item_id) AS rank
  FROM benchmark b CROSS JOIN cleaned c LEFT JOIN dots ON dots.query_id = b.item_id AND dots.item_id = c.item_id QUALIFY rank <= 20),
reqs AS (SELECT item_id AS query_id, CAST(item_id % 5 + 1 AS INTEGER) AS k, CASE WHEN item_id % 2 = 0 THEN 'gENERAL' END AS t,
    item_id % 7 = 3 AS failed, item_id % 3 <> 0 AND item_id % 7 <> 3 AS answered FROM benchmark),
titles AS (SELECT query_id, CASE WHEN rank = 3 THEN 1 ELSE 2 END AS place, name AS title FROM pool WHERE rank IN (1, 3)),
matched AS (SELECT t.query_id, t.place AS pos, min(p.rank) AS pool_rank FROM titles t JOIN reqs r USING (query_id) JOIN pool p USING (query_id)
  WHERE r.answered AND (contains(lower(p.name), lower(t.title)) OR contains(lower(t.title), lower(p.name))) GROUP BY 1, 2),
filled AS (SELECT query_id, pool_rank, pos FROM matched
  UNION ALL
  SELECT p.query_id, p.rank, (SELECT count(*) FROM matched m WHERE m.query_id = p.query_id) + row_number() OVER (PARTITION BY p.query_id ORDER BY p.rank)
  FROM pool p JOIN reqs r USING (query_id) WHERE NOT r.failed AND NOT EXISTS (SELECT 1 FROM matched m WHERE m.query_id = p.query_id AND m.pool_rank = p.rank)),
cut AS (SELECT f.query_id, f.pos, p.item_id, p.name, p.item_type, p.score, r.k, r.t, r.answered FROM filled f JOIN reqs r USING (query_id)
  JOIN pool p ON p.query_id = f.query_id AND p.rank = f.pool_rank WHERE f.pos <= 2 * r.k),
scored AS (SELECT *, CASE WHEN answered THEN round(least(greatest(first_value(score) OVER (PARTITION BY query_id ORDER BY pos), 0.3)
    * (1.0 - 0.03 * (max(pos) OVER (PARTITION BY query_id, item_id) - 1)), 0.99), 4) ELSE score END AS final FROM cut),
lexical AS (SELECT query_id, item_id, name, item_type, final AS score, 'rag' AS method,
    row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rank, k FROM scored WHERE t IS NULL OR lower(t) = lower(item_type)),
vecs AS (SELECT item_id, name, item_type, [{_letters_sql('embedding_text')}] AS v FROM cleaned),
asked AS (SELECT item_id AS query_id, [{_letters_sql('text')}] AS v FROM benchmark),
dense AS (SELECT a.query_id, c.item_id, c.name, c.item_type, coalesce(nullif(list_cosine_similarity(a.v, c.v), 'nan'::DOUBLE), 0) AS score, 'semantic' AS method,
    row_number() OVER (PARTITION BY a.query_id ORDER BY round(coalesce(nullif(list_cosine_similarity(a.v, c.v), 'nan'::DOUBLE), 0), 6) DESC, c.item_id) AS rank, r.k
  FROM asked a JOIN reqs r ON r.query_id = a.query_id AND r.failed JOIN vecs c ON r.t IS NULL OR lower(r.t) = lower(c.item_type)),
chosen AS (SELECT * FROM lexical WHERE rank <= k UNION ALL SELECT * FROM dense WHERE rank <= k)"""


def _third_and_first():
    """A stand-in for a re-ranking model: names the third and the first candidate of a prompt.

    It fails on some requests, by the length of their text.
    """

    def answer(prompt):
        query, rest = prompt[len(rerank.PROMPT_HEAD) :].split(rerank.PROMPT_CANDIDATES, 1)
        if len(query) % 3 == 0:
            raise TimeoutError
        lines = rest.split(rerank.PROMPT_SELECT, 1)[0].split("\n")
        return f"1. {lines[2][3:]}\n2. {lines[0][3:]}"

    return answer


def _flow(spark, sf, called=False):
    """Each benchmark text asks twice; the second is a repeat. Some requests fail, some have no answer of the model.

    Answers come from a table, or with ``called`` from a model that is asked.
    """
    index, items = catalog_plan.fit_catalog(clean.clean_catalog(_raw_catalog(spark, sf)))
    asked = _load(spark, sf, "benchmark").select("item_id", "text", F.explode(F.array(F.lit(0), F.lit(1_000_000))).alias("add"))
    key = F.col("item_id")
    requests = asked.select(
        (key + F.col("add")).alias("request_id"), F.col("text").alias("query"), (key % 5 + 1).cast("int").alias("k"),
        F.when(key % 2 == 0, F.lit("gENERAL")).alias("item_type"), F.lit("s").alias("session_id"), (key % 7 == 3).alias("failed"),
    )
    queries = requests.where(F.col("request_id") < 1_000_000).select(F.col("request_id").alias("query_id"), "query", "k", F.col("item_type").alias("query_type"))
    docs = catalog_plan.clean_catalog(_raw_catalog(spark, sf)).select("item_id", "name", "url", "item_type", "embedding_text")
    dense = vectors.encode(docs, "embedding_text", _letter_encoder)
    vector = vectors.encode(queries.select("query_id", "query"), "query", _letter_encoder).select("query_id", "vector")
    if called:
        return recommend_plan.answer(requests, index, items, load_answerer=_third_and_first, dense=(dense, vector), decimals=6)
    pools = recommend_plan.pools_for(index, items, queries, 6)
    name = lambda i: F.coalesce(F.get("pool", F.lit(i))["name"], F.lit(""))
    responses = pools.where(F.col("query_id") % 3 != 0).select("query_id", F.concat(F.lit("1. "), name(2), F.lit("\n2. "), name(0)).alias("content"))
    return recommend_plan.answer(requests, index, items, responses, dense=(dense, vector), decimals=6)


_RESULTS_SQL = f"""{_FLOW_SQL}, twice AS (SELECT query_id + a AS request_id, * FROM chosen, (VALUES (0), (1000000)) t(a))
SELECT request_id, query_id, item_id, name, item_type, round(score, 4) AS score, CAST(rank AS INTEGER) AS rank,
  CASE WHEN rank = 1 THEN CASE WHEN a > 0 THEN 'cached' ELSE method END END AS method FROM twice"""


def _flow_results(answers):
    found = rank.tag_first(recommend_plan.results(answers))
    return found.select("request_id", "query_id", "item_id", "name", "item_type", F.round("score", 4).alias("score"), "rank", "method")


@query(_RESULTS_SQL)
def recommend_reranked(spark, sf):
    """The whole flow: repeats, answers of the model, type wishes, failed requests with dense results."""
    return _flow_results(_flow(spark, sf))


@query(_RESULTS_SQL.replace("item_id % 3 <> 0 AND", "length(text) % 3 <> 0 AND"))
def recommend_called(spark, sf):
    """The same flow with a model that is asked for every distinct request, and fails on some."""
    return _flow_results(_flow(spark, sf, called=True))


@query(f"""{_FLOW_SQL}, n AS (SELECT query_id, count(*) AS n FROM chosen GROUP BY query_id)
SELECT query_id + a AS id, CAST(coalesce(n, 0) AS INTEGER) AS result_count, a > 0 AS cached,
  CASE WHEN a > 0 THEN 'cached' WHEN failed THEN 'semantic' ELSE 'rag' END AS method
FROM reqs LEFT JOIN n USING (query_id), (VALUES (0), (1000000)) t(a)""")
def recommend_log(spark, sf):
    """The log rows of the same flow."""
    answers = _flow(spark, sf)
    times = answers.select("request_id", F.lit(1.0).alias("query_time_ms"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    return recommend_plan.searches(answers, times).select("id", "result_count", "cached", "method")


# --- search log -------------------------------------------------------------


@query(f"""WITH {_REQUESTS_SQL}
SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, id DESC) AS INTEGER) AS rank, query, result_count,
  method, item_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at FROM searches QUALIFY rank <= 20""")
def history_topn(spark, sf):
    found = searchlog.latest(_event_searches(spark, sf))
    return found.select("session_id", "rank", "query", "result_count", "method", "item_type", _at("created_at"))


@query(f"""WITH {_REQUESTS_SQL}
SELECT query, result_count, method, item_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at FROM searches
WHERE session_id = '7' ORDER BY ts DESC, id DESC LIMIT 20""")
def session_history(spark, sf):
    found = searchlog.session_history(_event_searches(spark, sf), "7")
    return found.withColumn("created_at", _at("created_at"))


@query(f"""WITH {_REQUESTS_SQL} SELECT id, session_id, query FROM searches WHERE session_id NOT IN
(SELECT DISTINCT session_id FROM searches WHERE query_time_ms > 200)""")
def clear_session(spark, sf):
    history = _event_searches(spark, sf)
    slow = history.where(F.col("query_time_ms") > 200).select("session_id")
    return searchlog.without_sessions(history, slow).select("id", "session_id", "query")


@query(f"""WITH {_REQUESTS_SQL} SELECT id, session_id, query, result_count, method, query_time_ms, item_type,
strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at FROM searches WHERE NOT cached""")
def log_history_rows(spark, sf):
    rows = searchlog.history_rows(searchlog.logged(_event_searches(spark, sf)))
    return rows.withColumn("created_at", _at("created_at"))


@query(f"""WITH {_REQUESTS_SQL} SELECT id, query, result_count, method, query_time_ms, false AS cached,
strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at FROM searches WHERE NOT cached""")
def log_analytics_rows(spark, sf):
    rows = searchlog.analytics_rows(searchlog.logged(_event_searches(spark, sf)))
    return rows.withColumn("created_at", _at("created_at"))


def _stored_logs(spark, sf):
    """Both logs after three batches, deletes after the first and the second, and a compaction before the last two steps."""
    found = _event_searches(spark, sf)
    logs = log_store.day_logs(spark, new_folder(spark, "log"), 8)
    log_store.append_numbered(found.where("id % 3 = 0"), logs, 0)
    logs[0].clear(found.where("query_time_ms > 200").select("session_id"), 1)
    log_store.append_numbered(found.where("id % 3 = 1"), logs, 2)
    for log in logs:
        log.compact()
        log.vacuum()
    logs[0].clear(found.where("session_id like '%3'").select("session_id"), 3)
    log_store.append_numbered(found.where("id % 3 = 2"), logs, 4)
    return logs


_STORED_SQL = f"""WITH {_REQUESTS_SQL}, stored AS (SELECT * FROM searches WHERE NOT cached AND (id % 3 = 2 OR session_id NOT LIKE '%3' AND
  (id % 3 = 1 OR session_id NOT IN (SELECT session_id FROM searches WHERE query_time_ms > 200))))"""


@query(f"""{_STORED_SQL} SELECT id, session_id, query, result_count, method, query_time_ms, item_type,
strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at FROM stored""")
def log_stored(spark, sf):
    """The history as read back after appends, deletes and a compaction."""
    return _stored_logs(spark, sf)[0].read().drop("day", "bucket").withColumn("created_at", _at("created_at"))


@query(f"""{_STORED_SQL} SELECT query, result_count, method, item_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at FROM stored
WHERE session_id = '7' ORDER BY ts DESC, id DESC LIMIT 20""")
def log_stored_session(spark, sf):
    """One session's latest searches from its bucket of the stored history."""
    found = searchlog.session_history(_stored_logs(spark, sf)[0].of_key("7"), "7")
    return found.withColumn("created_at", _at("created_at"))


@query(f"""WITH {_REQUESTS_SQL} SELECT count(*) AS total_queries, round(coalesce(avg(query_time_ms), 0), 2) AS avg_query_time_ms FROM searches
WHERE NOT cached""")
def log_stored_summary(spark, sf):
    """Totals of the stored analytics, from which nothing is deleted."""
    return searchlog.query_summary(_stored_logs(spark, sf)[1].read())


@query(f"WITH {_REQUESTS_SQL} SELECT count(*) AS total_queries, round(coalesce(avg(query_time_ms), 0), 2) AS avg_query_time_ms FROM searches")
def log_summary(spark, sf):
    return searchlog.query_summary(_event_searches(spark, sf))


@query(f"""WITH {_REQUESTS_SQL} SELECT min(query) AS query, count(*) AS count FROM searches GROUP BY lower(query)
ORDER BY count DESC, lower(query) LIMIT 10""")
def top_queries(spark, sf):
    return searchlog.top_queries(_event_searches(spark, sf))


@query(f"""WITH {_REQUESTS_SQL}, t AS (SELECT min(query) AS query, count(*) AS n FROM searches GROUP BY lower(query) ORDER BY n DESC, lower(query) LIMIT 10)
SELECT (SELECT count(*) FROM part) AS total_items, 6 AS n_types, count(*) AS total_queries, round(avg(query_time_ms), 2) AS avg_query_time_ms,
  (SELECT string_agg(query || ':' || n, ',' ORDER BY n DESC, query) FROM t) AS top_queries FROM searches""")
def stats_row(spark, sf):
    row = searchlog.stats_row(_event_searches(spark, sf), _load(spark, sf, "part"))
    top = F.array_join(
        F.transform("top_queries", lambda s: F.concat(s["query"], F.lit(":"), s["count"].cast("string"))), ","
    )
    return row.select(
        "total_items", F.size("supported_types").alias("n_types"), "total_queries", "avg_query_time_ms", top.alias("top_queries")
    )


@query(f"""WITH {_REQUESTS_SQL}, f AS (SELECT *, request_id <> min(request_id) OVER (PARTITION BY query, k, item_type) AS hit FROM requests)
SELECT count(*) AS total_queries, round(avg(CAST(hit AS INTEGER)), 6) AS cache_hit_rate, round(avg(query_time_ms), 2) AS avg_query_time_ms FROM f""")
def cache_usage(spark, sf):
    requests = _event_requests(spark, sf)
    usage = searchlog.cache_usage(rank.attach_representative(requests, rank.distinct_requests(requests)))
    return usage.withColumn("cache_hit_rate", F.round("cache_hit_rate", 6))


@query(f"WITH {_ITEMS_SQL} SELECT item_id, count(*) AS n FROM ranked WHERE rank <= 10 GROUP BY item_id ORDER BY n DESC, item_id LIMIT 10")
def top_items(spark, sf):
    return searchlog.top_items(dense_topk(spark, sf))


@query(f"WITH {_ITEMS_SQL} SELECT item_type, count(*) AS n FROM ranked WHERE rank <= 10 GROUP BY item_type")
def result_types(spark, sf):
    items = _vector_items(spark, sf)
    found = vectors.recommend_dense(items, _vector_queries(items).select("query_id", "vector"), 10, decimals=6)
    return searchlog.result_types(found)


# --- evaluation -------------------------------------------------------------


@query("SELECT page_id, string_split(regexp_replace(trim(lower(url)), '/+$', ''), '/')[-1] AS slug FROM pages")
def slug(spark, sf):
    return _load(spark, sf, "pages").select("page_id", tx.slug(F.col("url")).alias("slug"))


def _truth(items):
    """Every item is a right answer to its label's question."""
    return items.select(
        F.col("item_type").alias("query"), F.concat(F.upper("url"), F.lit("//")).alias("url")
    )


def _label_queries(items):
    """One question per label, its vector that of the label's first item."""
    first = items.groupBy("label").agg(F.min("item_id").alias("item_id")).select("item_id")
    return items.join(first, "item_id").select(
        F.col("item_id").alias("query_id"), F.col("item_type").alias("query"), "vector"
    )


_TRUTH_SQL = f"""{_ITEMS_SQL}, truth AS (SELECT item_type AS query, CAST(item_id AS VARCHAR) AS slug FROM items),
firsts AS (SELECT item_type AS query, min(item_id) AS query_id FROM items GROUP BY item_type),
pred AS (SELECT query, CAST(item_id AS VARCHAR) AS slug, rank FROM ranked JOIN firsts USING (query_id) WHERE rank <= 10),
per AS (SELECT t.query, max(CAST(coalesce(p.rank <= 5, false) AS INTEGER)) AS hit_5, avg(CAST(coalesce(p.rank <= 5, false) AS INTEGER)) AS recall_5,
    max(CAST(coalesce(p.rank <= 10, false) AS INTEGER)) AS hit_10, avg(CAST(coalesce(p.rank <= 10, false) AS INTEGER)) AS recall_10
  FROM truth t LEFT JOIN pred p ON p.query = t.query AND p.slug = t.slug GROUP BY t.query)"""


@query(f"WITH {_ITEMS_SQL} SELECT item_type AS query, CAST(item_id AS VARCHAR) AS slug, count(*) AS n FROM items GROUP BY 1, 2")
def truth_counts(spark, sf):
    return evaluate.truth_counts(_truth(_vector_items(spark, sf)))


@query(f"WITH {_TRUTH_SQL} SELECT query, hit_5, round(recall_5, 6) AS recall_5, hit_10, round(recall_10, 6) AS recall_10 FROM per")
def query_hit_recall(spark, sf):
    items = _vector_items(spark, sf)
    asked = _label_queries(items)
    found = vectors.recommend_dense(items, asked.select("query_id", "vector"), 10, decimals=6)
    named = found.join(asked.select("query_id", "query"), "query_id")
    per = evaluate.query_metrics(_truth(items), named)
    return per.select("query", "hit_5", F.round("recall_5", 6).alias("recall_5"), "hit_10", F.round("recall_10", 6).alias("recall_10"))


@query(f"""WITH {_TRUTH_SQL} SELECT count(*) AS n_queries, round(avg(hit_5), 6) AS hit_5, round(avg(recall_5), 6) AS recall_5,
round(avg(hit_10), 6) AS hit_10, round(avg(recall_10), 6) AS recall_10 FROM per""")
def hit_recall(spark, sf):
    items = _vector_items(spark, sf)
    means = evaluate_dense(_truth(items), _label_queries(items), items, decimals=6)
    return means.select("n_queries", *[F.round(c, 6).alias(c) for c in means.columns if c != "n_queries"])


# --- pages ------------------------------------------------------------------


def _links_sql(marker):
    return f"""arrays AS (SELECT page_id, list_distinct(list_transform(
    list_filter(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda h: contains(replace(h, '&amp;', '&'), '{marker}')),
    lambda h: regexp_replace('https://x.test' || replace(h, '&amp;', '&'), '[#?].*$', ''))) AS l FROM pages),
links AS (SELECT page_id, unnest(l) AS link FROM arrays)"""


@query(f"WITH {_links_sql('/')} SELECT page_id, link FROM links")
def page_links(spark, sf):
    return pages.page_links(pages.link_arrays(_load(spark, sf, "pages"), "/", "https://x.test"))


@query(f"WITH {_links_sql('/')} SELECT link, min(page_id) AS first_page FROM links GROUP BY link")
def all_links(spark, sf):
    return pages.first_pages(page_links(spark, sf))


@query(f"WITH {_links_sql('/')} SELECT page_id, count(*) AS n_new FROM (SELECT link, min(page_id) AS page_id FROM links GROUP BY link) GROUP BY page_id")
def new_links(spark, sf):
    return pages.new_link_counts(page_links(spark, sf))


@query(f"""WITH {_links_sql('/')}, c AS (SELECT link, page_id, CAST(page_id % 2 AS INTEGER) AS crawl FROM links)
SELECT link, crawl, min(page_id) AS first_page FROM c SEMI JOIN (SELECT link, min(crawl) AS crawl FROM c GROUP BY link) f USING (link, crawl)
GROUP BY link, crawl""")
def crawl_frontier(spark, sf):
    """New links of two crawls, of the even and of the odd pages, against the stored ones."""
    path = new_folder(spark, "links")
    seen, links = SeenLinks(spark, path, "seen_" + path.rsplit("-", 1)[-1], 8), page_links(spark, sf)
    for crawl in range(2):
        seen.add(links.where(F.col("page_id") % 2 == crawl), crawl)
    return seen.stored()


@query(f"""WITH {_links_sql('e')} SELECT page_id, link FROM links
WHERE page_id < coalesce((SELECT min(page_id) FROM arrays WHERE len(l) = 0), page_id + 1)""")
def stop_rule(spark, sf):
    return pages.until_empty(pages.link_arrays(_load(spark, sf, "pages"), "e", "https://x.test"))


def _decode_sql(x):
    for name, char in (("&quot;", '"'), ("&#39;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&copy;", "©"), ("&middot;", "·")):
        x = f"replace({x}, '{name}', '{char}')"
    # A heading cut inside the entity still decodes, as in any HTML parser.
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


_STRIPPED = f"regexp_replace(s, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"
_PAGES_SQL = f"""parts AS (SELECT page_id, url, regexp_extract(html, '<h1>(.*?)</h1>', 1, 's') AS h1,
    split_part(substr(html, strpos(html, '<p><b>')), '</article>', 1) AS body FROM pages),
texts AS (SELECT page_id, url, array_to_string(list_transform(regexp_split_to_array(h1, '<[^>]*>'), lambda s: {_STRIPPED.replace('(s,', '(' + _decode_sql('s') + ',')}), '') AS h1,
    array_to_string(list_transform(regexp_split_to_array(body, '<[^>]*>'), lambda s: {_STRIPPED.replace('(s,', '(' + _decode_sql('s') + ',')}), '') AS p FROM parts),
rows AS (SELECT page_id, coalesce(nullif(h1, ''), 'Unknown Assessment') AS name,
    CASE WHEN length(p) <= 50 THEN 'No description available' WHEN length(p) > 200 THEN regexp_replace(substr(p, 1, 200), ' [^ ]*$', '') || '...' ELSE p END AS description,
    url FROM texts)"""


@query(f"WITH {_PAGES_SQL} SELECT page_id, name FROM rows")
def page_name(spark, sf):
    return pages.catalog_rows(_load(spark, sf, "pages")).select("page_id", F.col("Assessment Name").alias("name"))


_TITLE = _decode_sql("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")


@query(f"""SELECT page_id, coalesce(nullif(regexp_replace({_TITLE}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g'), ''), 'Unknown Assessment') AS name
FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)""")
def page_titles(spark, sf):
    """Pages without a heading are named by their title; those of badly labelled documents failed to load."""
    headless = F.replace(F.replace("html", F.lit("<h1>"), F.lit("<h6>")), F.lit("</h1>"), F.lit("</h6>"))
    bad = _load(spark, sf, "labels").where("quality = 0").select(F.col("doc_id").alias("page_id"), F.lit(True).alias("bad"))
    rows = _load(spark, sf, "pages").join(bad, "page_id", "left").withColumn("html", F.when(F.col("bad").isNull(), headless))
    return pages.catalog_rows(rows).select("page_id", F.col("Assessment Name").alias("name"))


@query(f"WITH {_PAGES_SQL} SELECT page_id, description FROM rows")
def page_description(spark, sf):
    rows = pages.catalog_rows(_load(spark, sf, "pages"))
    return rows.select("page_id", F.col("Short Description").alias("description"))


@query("SELECT count(*) AS n_items, count(*) * 100 / 377.0::DOUBLE AS coverage_pct FROM pages WHERE html IS NOT NULL")
def page_coverage(spark, sf):
    return pages.coverage(pages.catalog_rows(_load(spark, sf, "pages")), 377)


@query(f"WITH {_PAGES_SQL}, {_clean_sql('rows')} SELECT page_id AS item_id, name, description, url, embedding_text, item_type FROM cleaned")
def catalog_from_pages(spark, sf):
    return catalog_plan.catalog_from_pages(_load(spark, sf, "pages")).select(
        "item_id", "name", "description", "url", "embedding_text", "item_type"
    )


# --- exports ----------------------------------------------------------------


def _export_rows(spark, sf):
    items = _vector_items(spark, sf)
    found = vectors.recommend_dense(items, _vector_queries(items).select("query_id", "vector"), 3, decimals=6)
    asked = F.concat(F.lit("like "), F.col("query_id").cast("string")).alias("query")
    return found.withColumn("score", F.round("score", 6)).select("*", asked, F.lit("semantic").alias("method"))


_QUOTED = "'\"' || replace({c}, '\"', '\"\"') || '\"'"


@query(f"""WITH {_ITEMS_SQL} SELECT query_id, CAST(rank AS INTEGER) AS rank,
{_QUOTED.format(c='name')} || ',' || url || ',' || CAST(score AS VARCHAR) || ',' || item_type AS line FROM ranked WHERE rank <= 3""")
def export_csv(spark, sf):
    return export.csv_lines(_export_rows(spark, sf))


@query(f"""WITH {_ITEMS_SQL} SELECT query_id, CAST(rank AS INTEGER) AS rank, {_QUOTED.format(c='name')} || ',' || {_QUOTED.format(c='url')}
|| ',' || {_QUOTED.format(c='CAST(score AS VARCHAR)')} || ',' || {_QUOTED.format(c='item_type')} AS line FROM ranked WHERE rank <= 3""")
def export_csv_quoted(spark, sf):
    return export.csv_lines(_export_rows(spark, sf), quote_all=True)


_RESULTS_JSON = r"""'[' || string_agg('{"Assessment Name":"' || replace(name, '"', '\"') || '","URL":"' || url || '","score":' || CAST(score AS VARCHAR)
  || ',"assessment_type":"' || item_type || '"}', ',' ORDER BY rank) || ']'"""


@query(f"""WITH {_ITEMS_SQL} SELECT query_id, '{{"query":"like ' || query_id || '","exported_at":"2024-01-31 12:00:00","total":' || count(*)
|| ',"results":' || {_RESULTS_JSON} || '}}' AS json FROM ranked WHERE rank <= 3 GROUP BY query_id""")
def export_json(spark, sf):
    at = F.lit("2024-01-31 12:00:00").cast("timestamp")
    return export.json_envelopes(_export_rows(spark, sf), at)


@query(f"""WITH {_ITEMS_SQL} SELECT query_id, '{{"query":"like ' || query_id || '","results":' || {_RESULTS_JSON} || '}}' AS json
FROM ranked WHERE rank <= 3 GROUP BY query_id""")
def export_json_plain(spark, sf):
    return export.json_plain(_export_rows(spark, sf))
