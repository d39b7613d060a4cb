"""Queries from a stream, searched in a stored set: a stream-static join, without state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.search import similarity_join


def search_stream(queries: DataFrame, targets: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, **search) -> StreamingQuery:
    """Starts a query that searches each micro-batch of the streaming table queries and hands the rows to sink(rows, batch_id)."""

    def each(batch: DataFrame, batch_id: int) -> None:
        sink(similarity_join(batch, targets, **search), batch_id)

    return queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
