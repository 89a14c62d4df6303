"""Scoring of streams: predictions need no state, so a streaming frame goes through the same plan as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame

from larkspur.plans.model import Model


def score_stream(model: Model, stream: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Starts a query that appends predictions for every arriving row to Parquet files at ``path``."""
    if not stream.isStreaming:
        raise ValueError("a streaming frame is expected")
    writer = model.predict(stream).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
