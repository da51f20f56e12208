"""Structured Streaming over event tables: running outcomes and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TERMINAL = ("accepted", "failed", "exhausted")
STATE = "attempts int, status string"


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and type; windows close when the watermark passes them."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    g = e.groupBy(F.window("at", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def outcomes(attempts: DataFrame, key: str, accepted: str, failed: str, budget: int = 4) -> DataFrame:
    """key, attempts, status for each change: a record goes from pending to accepted, failed or, at the
    budget, exhausted; attempts after that are ignored. attempts: key long, event_type, ts, event_id.
    State is one row for each key; terminal ones stay, so repeats of a record are known."""
    import pandas as pd

    def step(group, parts, state: GroupState):
        n, status = state.get if state.exists else (0, "pending")
        before = (n, status)
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        for kind in rows["event_type"]:
            if status in TERMINAL:
                break
            n += 1
            status = "accepted" if kind == accepted else "failed" if kind == failed else "exhausted" if n >= budget else "pending"
        if (n, status) != before:
            state.update((n, status))
            yield pd.DataFrame({key: [group[0]], "attempts": [n], "status": [status]})

    return attempts.groupBy(key).applyInPandasWithState(step, f"{key} long, attempts int, status string", STATE, "update", GroupStateTimeout.NoTimeout)
