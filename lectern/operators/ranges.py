"""Joins of points with ranges, by equality on cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def range_join(points: DataFrame, point: str, ranges: DataFrame, lo: str, hi: str, width: int) -> DataFrame:
    """Rows of points and ranges with lo <= point <= hi; whole numbers.

    Each range goes to the cells of `width` that it touches and each point to its own, so the join
    is one on equality that shuffles or broadcasts like any other. Empty ranges meet nothing.
    """
    r = ranges.where(F.col(lo) <= F.col(hi)).withColumn("__cell", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    p = points.withColumn("__cell", F.floor(F.col(point) / width))
    return p.join(r, "__cell").where(F.col(point).between(F.col(lo), F.col(hi))).drop("__cell")
