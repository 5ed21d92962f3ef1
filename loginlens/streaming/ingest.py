"""Ingest a login stream into the profile store, one micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from loginlens.operators.segments import SKEW, SkewPolicy
from loginlens.plans.ingest import process_logins
from loginlens.sources.event_store import BUCKETS


def stream_ingest(logins: DataFrame, store: str, checkpoint: str, history: str = "stored",
                  skew: SkewPolicy = SKEW, history_limit: int | None = None, buckets: int = BUCKETS) -> DataStreamWriter:
    """A writer whose micro-batch n reads snapshot n - 1 and writes snapshot n.

    A batch repeated after a failure replaces only its own output.
    """
    def ingest(batch: DataFrame, batch_id: int) -> None:
        process_logins(batch, store, batch_id, batch_id - 1 if batch_id > 0 else None, history, skew,
                       history_limit, buckets)

    return logins.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint)
