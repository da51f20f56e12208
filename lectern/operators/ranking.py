"""Ranking of evaluation rows: best per group, tiers, curves. Ties always end in a stated column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def best_per_group(df: DataFrame, by: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """The row of the greatest key of each group, by partial aggregation: no group is sorted."""
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    return df.groupBy(*by).agg(F.max_by(F.struct(*columns), key).alias("__best")).select(*by, *[F.col(f"__best.{c}").alias(c) for c in columns if c not in by])


def leaders(df: DataFrame, score: str, *ties: Column, most: int | None = None) -> DataFrame:
    """Rows with rank from 1 by score, null last; with `most`, only those, by a top-k sort."""
    order = [F.desc_nulls_last(score), *ties]
    if most is not None:
        df = df.orderBy(*order).limit(most)
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def tiered(df: DataFrame, candidate: str, parsed: str, score: str, severe: str, high: int, low: int) -> DataFrame:
    """Rows of no severe failure and a score: those with parsed >= high if two candidates reach it,
    else those with parsed >= low; best row of each candidate, ranked."""
    hard = df.where(F.col(score).isNotNull() & (F.coalesce(severe, F.lit(0)) == 0) & (F.col(parsed) >= low))
    reach = hard.agg(F.countDistinct(F.when(F.col(parsed) >= high, F.col(candidate))).alias("__reach"))
    hard = hard.crossJoin(F.broadcast(reach)).where((F.col("__reach") < 2) | (F.col(parsed) >= high)).drop("__reach")  # one row
    best = best_per_group(hard, [candidate], [F.col(score), F.col(parsed)], [score, parsed])
    return leaders(best, score, F.desc(parsed), F.col(candidate))


def overfit(df: DataFrame, by: list[str], epoch: str, score: str, risk: str, drop: float = 3.0, more: int = 3) -> DataFrame:
    """Whether an epoch after the best one (the first of equals) loses `drop` points or adds `more` risks,
    and whether the last epoch is the best and above the one before."""
    best = df.groupBy(*by).agg(F.max_by(F.struct(F.col(epoch).alias("e"), F.col(score).alias("s"), F.col(risk).alias("r")), F.struct(F.col(score), -F.col(epoch))).alias("b"), F.max(epoch).alias("last"))
    j = df.join(best, by)
    later = F.col(epoch) > F.col("b.e")
    bad = later & ((F.col("b.s") - F.col(score) >= drop) | (F.col(risk) - F.col("b.r") >= more))
    before = F.max(F.when(F.col(epoch) == F.col("last") - 1, F.col(score)))
    return j.groupBy(*by).agg(F.bool_or(bad).alias("overfit"), F.coalesce(F.first("b.e") == F.first("last"), F.lit(False)).alias("ends_best"), (F.first("b.s") > before).alias("above_previous"))


def gap_to_leader(df: DataFrame, by: list[str], score: str, most: float) -> DataFrame:
    """Each row's distance to its group's best score, and whether it is within `most`."""
    top = F.max(score).over(Window.partitionBy(*by))
    return df.withColumn("gap", F.round(top - F.col(score), 6)).withColumn("close", F.col("gap") <= most)
