"""Geocoding of streams: each micro-batch is a table of its own, no state is kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import batch
from ..operators.index import Index


def geocoded_stream(stream: DataFrame, index: Index, path: str, checkpoint: str, columns: list[str] | None = None, locate: Callable[..., DataFrame] = batch.geocode_table, **trigger) -> StreamingQuery:
    """Writes each batch's rows and results to a folder of its number, so that a batch that runs again replaces its rows."""

    def each(rows: DataFrame, number: int) -> None:
        made = locate(rows, index, columns) if columns else locate(rows, index)
        made.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
