"""State of records over attempts: outcomes with a retry budget, latest status, resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outcomes(attempts: DataFrame, key: str, number: str, accepted: Column, failed: Column, budget: int) -> DataFrame:
    """Each record's outcome: that of its first attempt within the budget that is accepted or fails for
    good, else exhausted at the budget or pending below it. One aggregation; attempts aren't sorted."""
    within = F.col(number) <= budget
    end = F.min(F.when(within & (accepted | failed), F.struct(F.col(number).alias("at"), F.when(accepted, "accepted").otherwise("failed").alias("how"))))
    g = attempts.groupBy(key).agg(end.alias("e"), F.max(number).alias("last"))
    status = F.coalesce(F.col("e.how"), F.when(F.col("last") >= budget, "exhausted").otherwise("pending"))
    return g.select(key, status.alias("status"), F.coalesce("e.at", F.least("last", F.lit(budget))).alias("attempts_used"))


def latest(events: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The last event of each key by `order`."""
    return events.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("__l")).select(key, "__l.*")


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of todo that done lacks."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def drift(stored: DataFrame, current: dict[str, str], key: str = "setting", value: str = "value") -> DataFrame:
    """Settings whose stored and current values differ, one-sided ones too."""
    now = stored.sparkSession.createDataFrame(list(current.items()), f"{key} string, now string")
    j = stored.select(key, F.col(value).alias("before")).join(now, key, "full_outer")
    return j.where(~F.col("before").eqNullSafe(F.col("now")))
