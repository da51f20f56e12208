"""Deterministic samples: hash order, strata, quotas, even positions, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators.sequences import number_rows


def hash_order(seed: int, *keys: str) -> Column:
    """A pseudo-random order that any engine can repeat: SHA-256 of seed and keys."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]), 256)


def simple_sample(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows at random without replacement, by a top-k sort."""
    return df.withColumn("__h", hash_order(seed, key)).orderBy("__h", key).limit(n).drop("__h")


def stratified_sample(df: DataFrame, by: list[str], n: int | Column, seed: int, key: str) -> DataFrame:
    """n rows at most of each stratum at random (a reservoir that several tasks could keep)."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(hash_order(seed, key), key))
    return df.withColumn("__r", rank).where(F.col("__r") <= n).drop("__r")


def largest_remainder(counts: DataFrame, by: list[str], stratum: str, count: str, target: str) -> DataFrame:
    """counts with allocation: the group's target over strata in proportion, whole rows, never above the count.

    Remainders go to the greatest fractions, then in the order of the stratum's name.
    """
    w = Window.partitionBy(*by)
    ideal = F.col(target) * F.col(count) / F.sum(count).over(w)
    d = counts.withColumn("__ideal", ideal).withColumn("__floor", F.least(F.floor("__ideal"), F.col(count)))
    left = F.col(target) - F.sum("__floor").over(w)
    rank = F.row_number().over(w.orderBy(F.desc(F.round(F.col("__ideal") - F.floor("__ideal"), 9)), stratum))
    d = d.withColumn("__left", left).withColumn("__rank", rank)
    return d.withColumn("allocation", F.least(F.col("__floor") + (F.col("__rank") <= F.col("__left")).cast("long"), F.col(count))).drop("__ideal", "__floor", "__left", "__rank")


def at_even_position(pos: Column, size: Column, count: Column) -> Column:
    """Whether a position is one of `count` spread evenly over 0 .. size - 1, halves rounded to even.

    The i-th is round((i + 0.5) * size / count - 0.5), so only the i near its inverse can hit.
    """
    near = F.floor((pos + 0.5) * count / size)
    hit = F.lit(False)
    for shift in (-1, 0, 1):
        i = near + shift
        hit = hit | ((i >= 0) & (i < count) & (F.bround((i + 0.5) * size / count - 0.5).cast("long") == pos))
    return F.when(count <= 0, False).when(count >= size, pos < size).otherwise(hit)


def assign_splits(df: DataFrame, domain: str, bucket: str, order: list[str], val_percent: int, test_percent: int) -> DataFrame:
    """df with split: each cell's rows in order; val rows at even positions, test rows at even positions
    of the rest, train the others. Positions are numbered by many tasks, cells' sizes aggregated."""
    cell = [domain, bucket]
    n = df.groupBy(*cell).agg(F.count("*").alias("__n"))
    n = n.withColumn("__nv", F.floor(F.col("__n") * val_percent / 100)).withColumn("__nt", F.floor(F.col("__n") * test_percent / 100))
    d = number_rows(df, order, cell, "__pos").join(n, cell).withColumn("__val", at_even_position(F.col("__pos"), F.col("__n"), F.col("__nv")))
    # a row's position among the rest is its position less the val rows before it
    i = F.floor((F.col("__pos") + 0.5) * F.col("__nv") / F.col("__n"))
    before = F.greatest(i - 1, F.lit(0))
    for shift in (-1, 0, 1):
        k = i + shift
        place = F.bround((k + 0.5) * F.col("__n") / F.col("__nv") - 0.5).cast("long")
        before = before + ((k >= F.greatest(i - 1, F.lit(0))) & (k < F.col("__nv")) & (place < F.col("__pos"))).cast("long")
    before = F.when(F.col("__nv") <= 0, F.lit(0).cast("long")).otherwise(before)
    d = d.withColumn("__rest", F.col("__pos") - before)
    test = at_even_position(F.col("__rest"), F.col("__n") - F.col("__nv"), F.col("__nt"))
    split = F.when(F.col("__val"), "val").when(test, "test").otherwise("train")
    return d.withColumn("split", split).drop("__pos", "__n", "__nv", "__nt", "__val", "__rest")


def word_window(words: Column, length: int, key: Column) -> Column:
    """A run of `length` words whose start the key's CRC chooses; all words if there are no more."""
    start = F.crc32(key.cast("string").cast("binary")) % (F.size(words) - length + 1)
    return F.when(F.size(words) <= length, F.array_join(words, " ")).otherwise(F.array_join(F.slice(words, (start + 1).cast("int"), length), " "))
