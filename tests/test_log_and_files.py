import csv
import datetime as dt
import glob
import json

import pytest
from pyspark.sql import functions as F

from rankloom import schemas
from rankloom.operators import evaluate, searchlog, vectors
from rankloom.sources import export, tables
from rankloom.sources import searchlog as store
from rankloom.streaming.searchlog import log_searches

SEARCH = "id long, session_id string, query string, result_count int, method string, query_time_ms double, item_type string, created_at timestamp, cached boolean"
NOW = dt.datetime(2024, 1, 1, 12)


def searches(spark, rows):
    full = [(i, s, q, n, "rag", t, None, at, c) for i, s, q, n, t, at, c in rows]
    return spark.createDataFrame(full, SEARCH)


@pytest.fixture()
def log(spark):
    later = NOW + dt.timedelta(seconds=1)
    return searches(spark, [
        (1, "a", "Sales", 3, 10.0, NOW, False),
        (2, "a", "sales", None, 20.0, NOW, None),
        (3, "b", "SALES", 1, 30.005, later, False),
        (4, "a", "dev", 1, None, later, False),
        (5, "a", "dev", 1, 1.0, later, True),
    ])


def test_history_order_and_default(spark, log):
    rows = searchlog.latest(searchlog.logged(log), 2).where("session_id = 'a'").orderBy("rank").collect()
    assert [(r["query"], r.result_count) for r in rows] == [("dev", 1), ("sales", 0)]
    rows = searchlog.session_history(log, "a").collect()
    assert [r["query"] for r in rows] == ["dev", "dev", "sales", "Sales"]
    assert rows[0].asDict().keys() == {"query", "result_count", "method", "item_type", "created_at"}


def test_summary_and_top_queries(spark, log):
    row = searchlog.query_summary(searchlog.logged(log)).first()
    assert (row.total_queries, row.avg_query_time_ms) == (4, 20.0)
    assert searchlog.query_summary(log.where("id < 0")).first().avg_query_time_ms == 0.0
    top = [tuple(r) for r in searchlog.top_queries(log).collect()]
    assert top == [("SALES", 3), ("dev", 2)]
    stats = searchlog.stats_row(log, spark.range(388)).first()
    assert stats.total_items == 388 and stats.supported_types == schemas.ITEM_TYPES
    assert [tuple(t) for t in stats.top_queries] == top
    assert searchlog.cache_usage(log).first().cache_hit_rate == 0.25


def test_append_clear_and_retry(spark, log, tmp_path):
    history, analytics = (str(tmp_path / n) for n in ("h", "q"))
    for _ in range(2):  # a retried batch counts once
        store.append_searches(log.where("id <= 3"), history, analytics, "b1", 4)
    store.append_searches(log.where("id > 3"), history, analytics, "b2", 4)
    assert store.read_history(spark, history).count() == 4
    assert store.read_analytics(spark, analytics).where("not cached").count() == 4
    table = store.read_history(spark, history)
    one = store.one_session(table, "b", 4)
    assert [r["query"] for r in one.collect()] == ["SALES"]
    assert "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().executedPlan().toString()
    files = {f: f.stat().st_mtime_ns for f in tmp_path.glob("h/**/*.parquet")}
    kept = {f for f in files if spark.read.parquet(str(f)).where("session_id = 'a'").count() == 0}
    assert kept and store.clear_sessions(spark, history, spark.createDataFrame([("a",), ("a",)], "session_id string"), 4) == 1
    same = {f for f, at in files.items() if f.exists() and f.stat().st_mtime_ns == at}
    shared_bucket = {f for f in kept if any(f.parent.name == g.parent.name for g in files.keys() - kept)}
    assert kept - shared_bucket <= same
    left = store.read_history(spark, history)
    assert [r.session_id for r in left.collect()] == ["b"]
    assert searchlog.session_history(left, "a").count() == 0
    assert store.read_analytics(spark, analytics).count() == 4


def test_stream_feeds_both_logs_once(spark, log, tmp_path):
    source, history, analytics, check = (str(tmp_path / n) for n in ("in", "h", "q", "c"))
    log.coalesce(1).write.parquet(source)
    for expected in (4, 8):
        stream = spark.readStream.schema(log.schema).parquet(source)
        log_searches(stream, history, analytics, check).awaitTermination(120)
        assert store.read_history(spark, history).count() == expected
        assert store.read_analytics(spark, analytics).count() == expected
        log.withColumn("id", F.col("id") + 10).coalesce(1).write.mode("append").parquet(source)


RESULTS = "query_id long, query string, rank int, name string, url string, score double, item_type string, method string"


@pytest.fixture()
def results(spark):
    rows = [
        (1, "test query", 2, 'Say "hi", all', "https://example.com/2", 0.0, "General", None),
        (1, "test query", 1, "Test", "https://example.com", 0.9, "Cognitive", "rag"),
    ]
    return spark.createDataFrame(rows, RESULTS)


def test_csv_export(spark, results, tmp_path):
    for quote in (False, True):
        path = str(tmp_path / f"csv{quote}")
        export.write_csv(results.coalesce(1).sortWithinPartitions("rank"), path, quote)
        (part,) = glob.glob(path + "/part-*")
        raw = open(part).read()
        rows = list(csv.reader(raw.splitlines()))
        assert rows[0] == ["Assessment Name", "URL", "score", "assessment_type"]
        assert rows[1:] == [
            ["Test", "https://example.com", "0.9", "Cognitive"],
            ['Say "hi", all', "https://example.com/2", "0.0", "General"],
        ]
        assert ('"Test"' in raw) == quote


def test_json_export(spark, results, tmp_path):
    export.write_json(export.json_envelopes(results), str(tmp_path / "j"))
    (part,) = glob.glob(str(tmp_path / "j") + "/part-*")
    body = json.loads(open(part).read())
    assert list(body) == ["query", "exported_at", "total", "results"]
    assert body["total"] == 2 and dt.datetime.strptime(body["exported_at"], "%Y-%m-%d %H:%M:%S")
    assert [r["Assessment Name"] for r in body["results"]] == ["Test", 'Say "hi", all']
    plain = json.loads(export.json_plain(results).first().json)
    assert list(plain) == ["query", "results"] and plain["results"] == body["results"]


def test_catalog_csv_round_trip_and_null_tokens(spark, tmp_path):
    rows = [('A "q", x', "line one\nline two", "u1"), ("N/A", "None", "u2"), ("null", "", "nan"), ("nothing", "NA words", "u4")]
    raw = spark.createDataFrame(rows, "name string, description string, url string")
    tables.write_catalog(raw.coalesce(1), str(tmp_path / "c"))
    back = tables.read_catalog(spark, str(tmp_path / "c")).orderBy("seq")
    assert [tuple(r)[1:] for r in back.collect()] == [
        ('A "q", x', "line one\nline two", "u1"), (None, None, "u2"), (None, None, None), ("nothing", "NA words", "u4"),
    ]


def test_catalog_seq_follows_file_order(spark, tmp_path):
    for n, size in (("a", 2), ("b", 60)):
        with open(tmp_path / f"{n}.csv", "w") as f:
            f.write("Assessment Name,Short Description,URL\n" + "".join(f"{n}{i:02},d,u\n" for i in range(size)))
    back = tables.read_catalog(spark, str(tmp_path / "*.csv")).orderBy("seq")
    names = [r["name"] for r in back.collect()]
    assert names == sorted(names) and len(names) == 62


def test_truth_and_evaluation(spark, tmp_path):
    path = tmp_path / "truth.csv"
    path.write_text("Query,Assessment_url\nq1,https://X/Y/A/\nq1,https://x/a\nq1,https://x/b\nq2,https://x/z\n,https://x/y\nq3,NA\n")
    truth = tables.read_truth(spark, str(path))
    rows = [("q1", "https://x/A", 1), ("q1", "https://x/c", 2), ("q1", "http://other/b/", 7), ("q2", "https://x/w", 1)]
    predicted = spark.createDataFrame(rows, "query string, url string, rank int")
    per = {r["query"]: r for r in evaluate.query_metrics(truth, predicted).collect()}
    assert set(per) == {"q1", "q2"}
    assert per["q1"].hit_5 == 1 and per["q1"].recall_5 == pytest.approx(2 / 3) and per["q1"].recall_10 == 1.0
    assert per["q2"].hit_10 == 0 and per["q2"].recall_10 == 0.0
    mean = evaluate.mean_metrics(evaluate.query_metrics(truth, predicted)).first()
    assert (mean.n_queries, mean.hit_5, mean.recall_5) == (2, 0.5, pytest.approx(1 / 3))


def test_vectors_config_and_lists(spark, tmp_path):
    frame = spark.createDataFrame([(1, [0.5, 1.5]), (2, [1.0, 2.0])], schemas.EMBEDDINGS)
    tables.write_vectors(tables.with_item_ids(frame.drop("item_id")), str(tmp_path / "v"))
    back = tables.read_vectors(spark, str(tmp_path / "v"))
    assert back.select("item_id").distinct().count() == 2
    config = vectors.run_config(back, "m", "in.csv", "v", "v")
    tables.write_run_config(config, str(tmp_path / "config"))
    row = tables.read_run_config(spark, str(tmp_path / "config")).first()
    assert (row.model_name, row.embedding_dimension, row.num_assessments) == ("m", 2, 2)
    lists = spark.createDataFrame([(["a", "b"], ["u1", "u2"])], "name array<string>, url array<string>")
    assert [tuple(r) for r in tables.items_from_lists(lists, ["name", "url"]).collect()] == [(0, "a", "u1"), (1, "b", "u2")]
