"""Selection among candidates: quotas, replacements, refills, review picks, windows of sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keyword_match(text: Column, keywords: list[str], every: bool = False) -> Column:
    """Whether any (or every) keyword occurs between word edges, any blanks between its words."""
    def pattern(k: str) -> str:
        return "(?i)(?:^|[^A-Za-z0-9_])" + r"\s+".join(k.split()) + "(?=$|[^A-Za-z0-9_])"

    hits = [text.rlike(pattern(k)) for k in keywords]
    out = hits[0]
    for h in hits[1:]:
        out = out & h if every else out | h
    return out


def replace_failed(rows: DataFrame, pool: DataFrame, by: str, key: str, failed: Column) -> DataFrame:
    """The n-th failed row of each bucket with the n-th row of the pool in that bucket: key, replacement."""
    w = Window.partitionBy(by).orderBy(key)
    bad = rows.where(failed).select(by, key).withColumn("__n", F.row_number().over(w))
    new = pool.select(by, F.col(key).alias("replacement")).withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy("replacement")))
    return bad.join(new, [by, "__n"], "left").drop("__n")


def quotas(total: Column, percents: dict[str, int], rest: str) -> dict[str, Column]:
    """Whole shares of a total; what rounding leaves goes to `rest`."""
    out = {k: F.floor(total * p / 100) for k, p in percents.items()}
    left = total
    for c in out.values():
        left = left - c
    return out | {rest: left}


def first_by_priority(df: DataFrame, by: str, bucket: str, order: list[str], key: str, most: int) -> DataFrame:
    """At most `most` rows of each group: the first of each bucket in the order, then the others by key."""
    rank = F.array_position(F.array(*[F.lit(b) for b in order]), F.col(bucket))
    first = F.row_number().over(Window.partitionBy(by, bucket).orderBy(key)) == 1
    d = df.withColumn("__rank", F.when(first, rank).otherwise(len(order) + 1))
    n = F.row_number().over(Window.partitionBy(by).orderBy("__rank", key))
    return d.withColumn("pick", n).where(F.col("pick") <= most).drop("__rank")


def best_window(sentences: DataFrame, by: str, pos: str, words: str, least: int, most: int, target: int) -> DataFrame:
    """by, first, last, total: of each group the run of consecutive sentences of least..most words that is
    nearest to the target, then the longest in sentences, then the earliest.

    Runs are found from running totals: a start meets only the ends whose totals lie in its range, by
    equality on cells of `most` words, so a long text gives rows in proportion to its sentences.
    """
    w = Window.partitionBy(by).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    s = sentences.select(by, pos, words).withColumn("end", F.sum(words).over(w)).withColumn("start", F.col("end") - F.col(words))
    a = s.select(by, F.col(pos).alias("first"), F.col("start")).withColumn("cell", F.explode(F.sequence(F.floor((F.col("start") + least) / most), F.floor((F.col("start") + most) / most))))
    b = s.select(by, F.col(pos).alias("last"), F.col("end")).withColumn("cell", F.floor(F.col("end") / most))
    j = a.join(b, [by, "cell"]).withColumn("total", F.col("end") - F.col("start")).where((F.col("last") >= F.col("first")) & F.col("total").between(least, most))
    key = F.struct(F.abs(F.col("total") - target), F.col("first") - F.col("last"), F.col("first"))
    return j.groupBy(by).agg(F.min_by(F.struct("first", "last", "total"), key).alias("w")).select(by, "w.*")


def classify(scores: dict[str, Column], least: int, margin: int) -> Column:
    """The name of the greatest score, ties to the first, if it reaches `least` and leads by `margin`."""
    rows = F.array(*[F.struct(s.alias("s"), F.lit(-i).alias("o"), F.lit(n).alias("n")) for i, (n, s) in enumerate(scores.items())])
    top = F.sort_array(rows, asc=False)
    return F.when((top[0]["s"] >= least) & (top[0]["s"] - top[1]["s"] >= margin), top[0]["n"])
