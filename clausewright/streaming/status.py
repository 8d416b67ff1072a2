"""The latest status of each document, as a table and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DONE = ("ready", "failed")
STATUS = "doc_id bigint, status string, progress double, ts timestamp, updates bigint"
STATE = "status string, progress double, ts bigint, seq bigint, updates bigint"


def latest_status(updates: DataFrame) -> DataFrame:
    """updates(doc_id, seq, ts, status, progress): the newest of each document.

    A plain aggregation, so the same expression serves a batch table and a
    stream; only one row per document is kept as state, and a late update
    never replaces a newer one.
    """
    newest = F.max_by(F.struct("status", "progress", "ts"), F.struct("ts", "seq"))
    return (
        updates.groupBy("doc_id")
        .agg(newest.alias("_s"), F.count("*").alias("updates"))
        .select("doc_id", "_s.status", "_s.progress", "_s.ts", "updates")
    )


def stream_latest_status(updates: DataFrame, checkpoint: str, sink, trigger: dict | None = None):
    """Start the streaming form in update mode.

    `sink(batch, batch_id)` receives the documents whose status changed.
    """
    writer = (
        latest_status(updates).writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(sink)
    )
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _newest(key: tuple, batches: Iterator[pd.DataFrame], state, keep_ms: int) -> Iterator[pd.DataFrame]:
    """The state of one document brought up to date, or forgotten when its time is over."""
    if state.hasTimedOut:
        state.remove()
        return
    status, progress, ts, seq, updates = state.get if state.exists else (None, None, -(1 << 62), -(1 << 62), 0)
    for rows in batches:
        for s, p, t, n in zip(rows["status"], rows["progress"], rows["ts"].astype("datetime64[us]").astype("int64"), rows["seq"], strict=True):
            updates += 1
            if (t, n) >= (ts, seq):
                status, progress, ts, seq = s, None if pd.isna(p) else float(p), int(t), int(n)
    state.update((status, progress, ts, seq, updates))
    if status in DONE:
        # After the watermark in any case, so that the timer may be set.
        state.setTimeoutTimestamp(max(ts // 1000, state.getCurrentWatermarkMs()) + keep_ms)
    yield pd.DataFrame({
        "doc_id": [key[0]], "status": [status], "progress": [progress], "ts": pd.to_datetime([ts], unit="us"), "updates": [updates]})


def stream_bounded_status(
    updates: DataFrame, checkpoint: str, sink, late: str = "1 hour", keep_seconds: int = 3600, trigger: dict | None = None
):
    """The streaming form whose state is bounded: a finished document is forgotten.

    `late` is how far an update may lag behind the newest; later ones are dropped.
    A document that is ready or failed leaves the state when the watermark is
    `keep_seconds` past its last update, so a straggler older than the watermark
    cannot bring it back. Documents that are still in work stay.
    """
    def step(key, batches, state):
        return _newest(key, batches, state, keep_seconds * 1000)

    newest = (
        updates.select("doc_id", "seq", "ts", "status", "progress").withWatermark("ts", late)
        .groupBy("doc_id")
        .applyInPandasWithState(step, STATUS, STATE, "update", "EventTimeTimeout"))
    writer = newest.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
