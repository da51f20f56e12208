"""Operators along an order: numbering without a single task, neighbours."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.paragraphs import bound


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, if it has fewer: a small file is one partition,
    whose rows may each need much work. Tables larger than the cluster are left as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def settled(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the folder that spark.checkpoint.dir names; a local session without one gets a temporary folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if path is None and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="lectern-"))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as Parquet in the folder that spark.checkpoint.dir names (see `settled`): computed once, however often it is read."""
    sc = df.sparkSession.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lectern-")
    path = f"{path.rstrip('/')}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _range_keys(df: DataFrame, columns: list[str]) -> list[Column]:
    """Columns whose order never contradicts that of `columns`: all up to the first of strings, of which 64 characters."""
    keys = []
    for c in columns:
        if df.select(c).schema[0].dataType.typeName() == "string":
            return [*keys, F.left(F.col(c), F.lit(64)).alias(f"k{len(keys)}")]
        keys.append(F.col(c).alias(f"k{len(keys)}"))
    return keys


def range_part(df: DataFrame, columns: list[str], sampled: int = 20) -> Column:
    """Number of the range that a row lies in, of at most as many about equal ones as there are shuffle partitions.

    Ranges are cut at keys of a bounded sample, the rows of least hash, which are fixed here: a row's range depends on its
    columns only, so it is the same however often and with whatever other columns Spark computes it.
    """
    keys = _range_keys(df, columns)
    most = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 200) * sampled
    sample = df.select(*keys, F.xxhash64(*columns).alias("h")).orderBy("h").limit(most).drop("h")
    rows = sample.orderBy(*sample.columns).collect()[sampled::sampled]
    if not rows:
        return F.lit(0)
    cuts = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, sample.schema.fields, strict=True)]) for r in rows])
    return bound(F.struct(*keys), lambda k: F.size(F.filter(cuts, lambda c: c <= k)))


def number_rows(df: DataFrame, order: list[str], by: list[str] | None = None, name: str = "number") -> DataFrame:
    """Rows numbered from 0 in the order of unique keys, within each group of `by` if given.

    Rows are numbered in each range (`range_part`) and group, and shifted by the counts of the ranges before,
    so that a group however large is numbered by many tasks. df is computed more than once: it must give the same rows.
    """
    by = by or []
    d = df.withColumn("__part", range_part(df, [*by, *order]))
    n = d.groupBy("__part", *by).agg(F.count("*").alias("__n"))
    d = d.withColumn("__within", F.row_number().over(Window.partitionBy("__part", *by).orderBy(*order)))
    w = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    n = n.withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0))).drop("__n")
    right = n.withColumnsRenamed({c: f"__r{c}" for c in ["__part", *by]})
    same = F.expr(" and ".join(f"`{c}` <=> `__r{c}`" for c in ["__part", *by]))
    return d.join(right, same).withColumn(name, F.col("__before") + F.col("__within") - 1).drop("__part", "__within", "__before", *[f"__r{c}" for c in ["__part", *by]])


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision, 0 for a zero vector."""
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def adjacent_pairs(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, next_id, similarity of each row and the next in the order of key.

    Neighbours meet by their number: rows are dealt out with their own number and with the next one.
    """
    d = number_rows(df, [key])
    both = d.select(F.col("number").alias("at"), F.lit(0).alias("side"), key, vector).unionAll(d.select((F.col("number") - 1).alias("at"), F.lit(1).alias("side"), key, vector))
    g = both.groupBy("at").agg(*[F.max(F.when(F.col("side") == s, F.struct(key, vector))).alias(n) for s, n in ((0, "a"), (1, "b"))])
    g = g.where("a is not null and b is not null")
    return g.select(F.col(f"a.{key}").alias(key), F.col(f"b.{key}").alias("next_id"), F.round(cosine(F.col(f"a.{vector}"), F.col(f"b.{vector}")), 6).alias("similarity"))
