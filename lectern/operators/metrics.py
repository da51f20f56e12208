"""Aggregations: shares, histograms, cross-tabs, statistics, rates. DataFrame in, DataFrame out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as X
from lectern.operators.cuts import computed
from lectern.operators.sequences import written

# fixed values: the eleven bins of the length histogram
LENGTH_BINS = [("<=300", None, 300), ("301-400", 301, 400), ("401-500", 401, 500), ("501-600", 501, 600), ("601-700", 601, 700), ("701-800", 701, 800), ("801-900", 801, 900), ("901-1000", 901, 1000), ("1001-1100", 1001, 1100), ("1101-1200", 1101, 1200), (">1200", 1201, None)]
PERCENTS = (10, 25, 33, 50, 67, 75, 90, 95, 99)


def share(count: str, *within: str) -> Column:
    """Percent of a count among its group's, for grouped rows."""
    w = Window.partitionBy(*within)
    return 100.0 * F.col(count) / F.sum(count).over(w)


def histogram(df: DataFrame, value: str, bins: list) -> DataFrame:
    """bin, n, percent for fixed bins (label, least, most; None is open), empty ones too. One aggregation."""
    label = F.lit(None).cast("string")
    for name, lo, hi in reversed(bins):
        inside = (F.lit(True) if lo is None else F.col(value) >= lo) & (F.lit(True) if hi is None else F.col(value) <= hi)
        label = F.when(inside, name).otherwise(label)
    n = df.groupBy(label.alias("bin")).agg(F.count("*").alias("n")).where("bin is not null")
    every = df.sparkSession.createDataFrame([(b[0],) for b in bins], "bin string")
    out = every.join(F.broadcast(n), "bin", "left").fillna(0, ["n"])  # as many rows as bins
    return out.withColumn("percent", F.round(share("n"), 6))


def cross_tab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of `column`'s values side by side for each row value, with totals; values are given, so
    no extra pass looks for them."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values], F.count("*").alias("total"))


def length_stats(df: DataFrame, by: list[str], value: str, digits: int = 4) -> DataFrame:
    """min, p10 to p99 by linear interpolation, max, mean and n. One percentile call shares its buffer."""
    q = F.percentile(value, F.array(*[F.lit(p / 100) for p in PERCENTS]))
    g = df.groupBy(*by).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.round(F.avg(value), digits).alias("mean"), F.count("*").alias("n"), q.alias("q"))
    return g.select(*by, "min", "max", "mean", "n", *[F.round(F.col("q")[i], digits).alias(f"p{p}") for i, p in enumerate(PERCENTS)])


def audit_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """min, p05, median, mean, p95, max."""
    r = lambda c, name: F.round(c, 4).alias(name)
    return df.groupBy(*by).agg(F.min(value).alias("min"), r(F.percentile(value, 0.05), "p05"), r(F.median(value), "median"), r(F.avg(value), "mean"), r(F.percentile(value, 0.95), "p95"), F.max(value).alias("max"))


def nearest_rank(df: DataFrame, by: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Percentiles that occur among the values, with min and max; whole numbers."""
    q = [F.expr(f"cast(percentile_disc({p}) within group (order by {value}) as bigint)").alias(name) for name, p in quantiles.items()]
    return df.groupBy(*by).agg(*q, F.min(value).alias("min"), F.max(value).alias("max"))


def score_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, median, population standard deviation, min, max."""
    r = lambda c, name: F.round(c, 9).alias(name)
    return df.groupBy(*by).agg(F.count(value).alias("n"), r(F.avg(value), "mean"), r(F.median(value), "median"), r(F.stddev_pop(value), "stddev"), r(F.min(value), "min"), r(F.max(value), "max"))


def flag_rates(df: DataFrame, by: list[str], flags: list[str], total: str = "n") -> DataFrame:
    """For each boolean column its count and its percent of the group."""
    g = df.groupBy(*by).agg(F.count("*").alias(total), *[F.count_if(F.col(f)).alias(f) for f in flags])
    return g.withColumns({f"{f}_rate": F.round(100.0 * F.col(f) / F.col(total), 6) for f in flags})


def tag_counts(df: DataFrame, tags: str) -> DataFrame:
    """tag, n over an array column; null and 'none' don't count."""
    t = df.select(F.explode(tags).alias("tag")).where("tag is not null and tag <> 'none'")
    return t.groupBy("tag").agg(F.count("*").alias("n"))


def flag_examples(df: DataFrame, flags: dict[str, Column], key: str, most: int) -> DataFrame:
    """flag, n, examples: how many rows have each flag and the first keys. Two small aggregations; only
    the first `most` keys of a flag are gathered."""
    names = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]), lambda x: x.isNotNull())
    f = df.select(key, F.explode(names).alias("flag"))
    n = f.groupBy("flag").agg(F.count("*").alias("n"))
    top = f.withColumn("rn", F.row_number().over(Window.partitionBy("flag").orderBy(key))).where(F.col("rn") <= most)
    ex = top.groupBy("flag").agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x.cast("string")), ",").alias("examples"))
    return n.join(ex, "flag")


def term_stats(docs: DataFrame, by: str, least: int = 1) -> DataFrame:
    """by, term, tf, df, idf = ln((1 + N) / (1 + df)) + 1 with N documents in the group.

    Terms are counted where their row is read, so that sums move and no row's terms do. Only rows that share a doc_id in
    their group meet, since they are one document; rows without doc_id count in tf and N.
    """
    rows = docs.select("doc_id", by, "text").where(F.col(by).isNotNull())
    again = written(rows.where("doc_id is not null").groupBy(by, "doc_id").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    shared = not again.isEmpty()
    d = computed(rows.join(again, [by, "doc_id"], "left_anti") if shared else rows, tokens=X.tokens(F.col("text")))

    def marked(terms, first):
        return F.transform(terms, lambda x: F.struct(x.alias("term"), first.alias("first")))

    d = d.select(by, F.inline(F.concat(marked(F.col("tokens"), F.lit(False)), marked(F.array_distinct("tokens"), F.lit(True)))), F.col("doc_id").isNotNull().alias("known"))
    d = d.groupBy(by, "term").agg(F.count_if(~F.col("first")).alias("tf"), F.count_if(F.col("first") & F.col("known")).alias("df"))
    if shared:
        w = rows.join(again, [by, "doc_id"], "left_semi").select("doc_id", by, F.explode(X.tokens(F.col("text"))).alias("term")).groupBy(by, "term", "doc_id").agg(F.count("*").alias("k"))
        d = d.unionByName(w.groupBy(by, "term").agg(F.sum("k").alias("tf"), F.count("*").alias("df"))).groupBy(by, "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    n = docs.groupBy(by).agg(F.count("*").alias("docs"))
    return d.where(F.col("df") >= least).join(n, by).select(by, "term", "tf", "df", F.round(F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1, 9).alias("idf"))
