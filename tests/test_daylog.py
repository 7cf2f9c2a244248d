import datetime as dt

import pytest

from rankloom.sources import daylog
from rankloom.sources import searchlog as store
from rankloom.streaming.searchlog import log_numbered

SEARCH = "id long, session_id string, query string, result_count int, method string, query_time_ms double, item_type string, created_at timestamp, cached boolean"
NOW = dt.datetime(2024, 1, 1, 12)


def batch(spark, *rows):
    """Searches from (id, session, days after the first)."""
    full = [(i, s, f"q{i}", 1, "rag", 1.0, None, None if d is None else NOW + dt.timedelta(days=d), False) for i, s, d in rows]
    return spark.createDataFrame(full, SEARCH)


def sessions(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "session_id string")


def ids(log):
    return sorted(r.id for r in log.read().collect())


@pytest.fixture()
def logs(spark, tmp_path):
    return store.day_logs(spark, str(tmp_path / "log"), 4)


@pytest.fixture()
def filled(spark, logs):
    store.append_numbered(batch(spark, (1, "a", 0), (2, "b", 0), (3, "a", 1), (4, None, None)), logs, 0)
    logs[0].clear(sessions(spark, "a", "a", None), 1)
    store.append_numbered(batch(spark, (5, "a", 1), (6, "c", 2)), logs, 2)
    return logs


def test_deletes_hide_older_rows_only(spark, filled):
    history, analytics = filled
    assert ids(history) == [2, 4, 5, 6] and ids(analytics) == [1, 2, 3, 4, 5, 6]
    assert {str(r.day) for r in history.read().collect()} == {"2024-01-01", "2024-01-02", "2024-01-03", "None"}
    assert [r.id for r in history.of_key("a").collect()] == [5]


def test_compaction_changes_no_row_and_only_touched_days(spark, filled):
    history, analytics = filled
    before = sorted(map(tuple, history.read().collect()), key=str)
    assert history.compact() == 4 and analytics.compact() == 4
    assert sorted(map(tuple, history.read().collect()), key=str) == before and history.compact() == 0
    first = history.manifest()
    history.clear(sessions(spark, "c"), 3)
    store.append_numbered(batch(spark, (7, "b", 0)), filled, 4)
    assert ids(history) == [2, 4, 5, 7]
    assert history.compact() == 1  # the third day has no rows left
    second = history.manifest()
    assert second.spans == [[0, 4]] and set(second.days) == {"2024-01-01", "2024-01-02", daylog.NO_DAY}
    assert {d for d in second.days if second.days[d] == first.days[d]} == {"2024-01-02", daylog.NO_DAY}
    assert ids(history) == [2, 4, 5, 7]
    assert history.vacuum() > 0 and ids(history) == [2, 4, 5, 7] and history.vacuum() == 0
    assert ids(analytics) == [1, 2, 3, 4, 5, 6, 7]


def test_one_session_reads_one_bucket(spark, filled):
    history, _ = filled
    history.compact()
    found = history.of_key("b")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and [r.id for r in found.collect()] == [2]


def test_unfinished_batch_is_not_seen_and_written_again(spark, filled, tmp_path):
    history, _ = filled
    rows = batch(spark, (8, "d", 3)).select(*history.fields.names)
    rows.write.parquet(f"{history.path}/rows/seq=4/day=2024-01-04")
    store.append_numbered(batch(spark, (9, "d", 3)), filled, 6)
    assert ids(history) == [2, 4, 5, 6, 9]
    history.compact()
    assert history.manifest().last == 2 and ids(history) == [2, 4, 5, 6, 9]
    store.append_numbered(batch(spark, (8, "d", 3)), filled, 4)
    assert ids(history) == [2, 4, 5, 6, 8, 9]
    history.compact()
    assert history.manifest().last == 6 and ids(history) == [2, 4, 5, 6, 8, 9]


def test_failures_between_steps_lose_nothing(spark, filled, monkeypatch):
    history, _ = filled
    with monkeypatch.context() as patch:
        patch.setattr(daylog.DayLog, "_swap", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            history.compact()
    assert ids(history) == [2, 4, 5, 6]
    assert history.compact() == 4 and ids(history) == [2, 4, 5, 6]
    # Batches that come again after the compaction count once.
    store.append_numbered(batch(spark, (5, "a", 1), (6, "c", 2)), filled, 2)
    assert not history.clear(sessions(spark, "a"), 1) and ids(history) == [2, 4, 5, 6]
    done = []
    with monkeypatch.context() as patch:
        delete = daylog.DayLog._delete
        patch.setattr(daylog.DayLog, "_delete", lambda log, *parts: delete(log, *parts) if not done and not done.append(parts) else 1 / 0)
        with pytest.raises(ZeroDivisionError):
            history.vacuum()
    assert ids(history) == [2, 4, 5, 6] and history.vacuum() > 0 and ids(history) == [2, 4, 5, 6]


def test_numbers_out_of_order_are_an_error(spark, logs):
    store.append_numbered(batch(spark, (1, "a", 0)), logs, 5)
    logs[0].compact()
    with pytest.raises(ValueError):
        logs[0].append(batch(spark, (2, "a", 0)), 4)


def test_empty_logs_and_batches(spark, logs):
    history, _ = logs
    assert ids(history) == [] and history.compact() == 0 and history.vacuum() == 0
    store.append_numbered(batch(spark, (1, "a", 0)).where("id > 1"), logs, 0)
    history.clear(sessions(spark, None), 1)
    assert ids(history) == [] and history.compact() == 0 and history.manifest().last == 1
    assert ids(history) == [] and history.of_key("a").count() == 0


def test_stream_with_a_restart_and_a_delete_between(spark, logs, tmp_path):
    history, analytics = logs
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    for number, expected in enumerate(([1, 2], [2, 3, 4])):
        batch(spark, *[(2 * number + 1, "a", number), (2 * number + 2, "b", number)]).coalesce(1).write.mode("append").parquet(source)
        log_numbered(spark.readStream.schema(SEARCH).parquet(source), logs, check).awaitTermination(120)
        assert ids(history) == expected
        if not number:
            history.clear(sessions(spark, "a"), 1)
        history.compact()
    assert ids(analytics) == [1, 2, 3, 4]
