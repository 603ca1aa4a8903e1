"""Streaming forms of the session and job operators, on event time.

The reference clock of these operators is the arrival of events; here it is the column ts, so that a stream
and a batch of the same events agree. Rows later than the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_counts(events: DataFrame, idle: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: a gap of ``idle`` ends one. Batch or streaming input (append mode)."""
    df = events.withColumn("ts", F.col("ts").cast("timestamp"))
    df = df.withWatermark("ts", late) if events.isStreaming else df
    return (
        df.groupBy(F.session_window("ts", idle).alias("w"), "user_id")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select("user_id", F.col("w.start").alias("opened"), F.col("w.end").alias("closes"), "n", "total")
    )


def job_progress(events: DataFrame) -> DataFrame:
    """Counters of each job, event by event (update or complete mode)."""
    one = lambda kind: F.count(F.when(F.col("event_type") == kind, 1))
    return events.groupBy(F.col("user_id").alias("job")).agg(F.count("*").alias("total"), one("view").alias("completed"), one("error").alias("n_errors"))


def webhook_sink(df: DataFrame, deliver: Callable[[list[str]], None], events: tuple[str, ...], checkpoint: str, prefix: str = "crawl"):
    """Start a stream that hands the payloads of the configured events to ``deliver``, partition by partition."""

    def send(batch: DataFrame, _: int) -> None:
        rows = batch.where(F.col("event_type").isin(*events)).select(
            F.to_json(F.struct(F.lit(True).alias("success"), F.concat(F.lit(prefix + "."), "event_type").alias("type"), F.col("user_id").alias("id"), F.array("value").alias("data"))).alias("payload")
        )
        rows.foreachPartition(lambda part: deliver([r.payload for r in part]))

    return df.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_store(actions: DataFrame, idle_s: int = 60, life_s: int = 600, late: str = "10 seconds") -> DataFrame:
    """A keyed store of sessions over a stream of actions (session_id, ts, type), on event time: rows of a session as
    (session_id, opened, last_at, n, state). A session opens with its first action; it ends with a close, or when the
    watermark passes its idle time or its lifetime, and is then forgotten. 'open' rows are the session after a
    batch; every ended session gives one 'closed' or 'expired' row."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    columns = ["session_id", "opened", "last_at", "n", "state"]

    def step(key, batches, state):
        out = []

        def row(at, last, n, how):
            out.append((key[0], at, last, n, how))

        if state.hasTimedOut:
            row(*state.get, "expired")
            state.remove()
        else:
            opened, last, n = state.get if state.exists else (None, 0, 0)
            rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
            for at, kind in zip(rows["ts"].astype("datetime64[s]").astype("int64"), rows["type"], strict=True):
                at = int(at)
                if opened is not None and (at - last > idle_s or at - opened > life_s):
                    row(opened, last, n, "expired")
                    opened = None
                opened, last, n = (at, at, 1) if opened is None else (opened, max(at, last), n + 1)
                if kind == "close":
                    row(opened, last, n, "closed")
                    opened = None
            if opened is None:
                if state.exists:
                    state.remove()
            else:
                row(opened, last, n, "open")
                state.update((opened, last, n))
                state.setTimeoutTimestamp(max(1000 * (min(last + idle_s, opened + life_s) + 1), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=columns)

    return actions.withWatermark("ts", late).groupBy("session_id").applyInPandasWithState(
        step, "session_id long, opened long, last_at long, n long, state string", "opened long, last_at long, n long", "append", GroupStateTimeout.EventTimeTimeout
    )
