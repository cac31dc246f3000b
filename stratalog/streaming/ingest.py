"""Structured Streaming into a log table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from stratalog.sources.ingest import decode_lines
from stratalog.sources.table import LogTable


def start(lines: DataFrame, table: LogTable, checkpoint: str, name: str, interval: str | None = None, column: str = "value") -> StreamingQuery:
    """Take in a stream of JSON lines; every micro-batch becomes parts.

    The table remembers the last batch of each stream name, so a batch that is run again after a
    failure is written once. Late rows are taken in like any other: there is no watermark.
    """

    def write(batch: DataFrame, number: int) -> None:
        table.append_frame(decode_lines(batch, table.fields, column), batch=(name, number))

    writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
