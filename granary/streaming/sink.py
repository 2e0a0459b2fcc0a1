"""Micro-batches of a stream appended to a stored table, each once, also after a restart."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Table


def append_stream(stream: DataFrame, table: Table, checkpoint: str, maintain_indexes: bool = False, **trigger: Any) -> StreamingQuery:
    """Append every micro-batch. The number of the last batch that is in the table is committed with its rows, by
    which a batch that is given again after a failure is known and left out."""
    path, spark = table.path, table.spark

    def batch(df: DataFrame, number: int) -> None:
        now = Table.open(spark, path)
        seen = now.manifest.get("streams", {})
        if seen.get(checkpoint, -1) >= number:
            return
        now.manifest["streams"] = seen | {checkpoint: number}  # goes into the manifest that the append commits
        settled = df.persist()
        try:
            now.append(settled, maintain_indexes)
        finally:
            settled.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
