"""Incremental scoring. Scoring is a map over records, so a stream of run files needs no state: each
micro-batch is scored and appended, and the summaries are batch queries over what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from spanmill.operators import match


def score_stream(records: DataFrame, out: str, checkpoint: str, mode: str = "span", how: str = "full") -> StreamingQuery:
    """Scores a streaming frame of records (preds, gold) into Parquet until all that is there is read."""
    scored = match.scored(records, ((mode, how, "f1+"),))
    return scored.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
