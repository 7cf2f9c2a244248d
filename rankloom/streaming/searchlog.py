"""A continuous feed of searches into the log tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from rankloom.sources.daylog import DayLog
from rankloom.sources.searchlog import append_numbered, append_searches


def log_searches(
    searches: DataFrame, history_path: str, analytics_path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Append a stream of searches with the batch writer.

    The batch number names the folder, so a micro-batch run again after a
    failure replaces its own rows. The stream keeps no state.
    """

    def write(batch: DataFrame, number: int) -> None:
        append_searches(batch, history_path, analytics_path, f"stream-{number}")

    writer = searches.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def log_numbered(searches: DataFrame, logs: tuple[DayLog, DayLog], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append a stream of searches to logs of numbered batches: micro-batch n has the number 2n.

    The odd numbers between are free for deletes.
    """

    def write(batch: DataFrame, number: int) -> None:
        append_numbered(batch, logs, 2 * number)

    writer = searches.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
