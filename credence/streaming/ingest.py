"""Events from a stream into the canonical schema, once each, for the batch audit to read."""

from __future__ import annotations

from pyspark.sql import DataFrame

from credence.schema import ColumnMapping, canonical


def canonical_stream(events: DataFrame, columns: ColumnMapping | dict | None = None, late: str = "1 day") -> DataFrame:
    """A streaming frame (with ``row_id``) in canonical columns; repeats of a row within the watermark are dropped."""
    if "row_id" not in events.columns:
        raise ValueError("a stream needs a row_id")
    return canonical(events, columns).where("timestamp is not null").withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["row_id"])
