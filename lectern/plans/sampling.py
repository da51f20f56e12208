"""Queries that sample, allocate and split."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators import sampling as S
from lectern.plans.aggregates import _SIZED, sized
from lectern.plans.registry import query


@query("SELECT doc_id, lang FROM documents ORDER BY sha256('42:' || doc_id), doc_id LIMIT 50")
def simple_hash_sample(t):
    """Fifty documents at random."""
    return S.simple_sample(t.documents.select("doc_id", "lang"), 50, 42, "doc_id")


@query(_SIZED + " SELECT doc_id, lang, bucket, words FROM d QUALIFY row_number() OVER (PARTITION BY lang, bucket ORDER BY sha256('5120:' || doc_id), doc_id) <= 10")
def stratified_hash_sample(t):
    """Ten documents of each language and bucket at random."""
    return S.stratified_sample(sized(t.documents).drop("source"), ["lang", "bucket"], 10, 5120, "doc_id")


_ALLOCATED = _SIZED + """, c AS (SELECT source, bucket, count(*) AS n FROM d GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY source) // 5 AS target FROM c),
i AS (SELECT *, target * CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY source) AS ideal FROM t), f AS (SELECT *, least(floor(ideal), n) AS fl FROM i),
r AS (SELECT *, target - sum(fl) OVER (PARTITION BY source) AS spare, row_number() OVER (PARTITION BY source ORDER BY round(ideal - floor(ideal), 9) DESC, bucket) AS rank FROM f)"""


@query(_ALLOCATED + " SELECT source, bucket, n, CAST(target AS BIGINT) AS target, CAST(least(fl + CASE WHEN rank <= spare THEN 1 ELSE 0 END, n) AS BIGINT) AS allocation FROM r")
def largest_remainder(t):
    """A fifth of each source, over buckets by largest remainder."""
    c = sized(t.documents).groupBy("source", "bucket").agg(F.count("*").alias("n"))
    c = c.withColumn("target", F.floor(F.sum("n").over(Window.partitionBy("source")) / 5))
    return S.largest_remainder(c, ["source"], "bucket", "n", "target")


_SPLIT = _SIZED + """, p AS (SELECT *, row_number() OVER (PARTITION BY lang, bucket ORDER BY words, sha256(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang, bucket) AS n FROM d),
q AS (SELECT *, n * 10 // 100 AS nv, n * 10 // 100 AS nt FROM p),
v AS (SELECT *, list_contains(list_transform(range(0, nv), lambda i: CAST(round_even((i + 0.5) * n / CAST(nv AS DOUBLE) - 0.5, 0) AS BIGINT)), pos) AS isval FROM q),
r AS (SELECT *, sum(CASE WHEN isval THEN 0 ELSE 1 END) OVER (PARTITION BY lang, bucket ORDER BY pos) - 1 AS rest FROM v),
s AS (SELECT doc_id, lang, bucket, words, CASE WHEN isval THEN 'val' WHEN list_contains(list_transform(range(0, nt), lambda i: CAST(round_even((i + 0.5) * (n - nv) / CAST(nt AS DOUBLE) - 0.5, 0) AS BIGINT)), CAST(rest AS BIGINT)) THEN 'test' ELSE 'train' END AS split FROM r)"""


def _split(t):
    d = sized(t.documents).drop("source").withColumn("h", F.sha2(F.col("doc_id").cast("string"), 256))
    return S.assign_splits(d, "lang", "bucket", ["words", "h", "doc_id"], 10, 10).drop("h")


@query(_SPLIT + " SELECT doc_id, lang, bucket, words, split FROM s")
def split_assignment(t):
    """Train, val and test rows evenly over the length order of each cell."""
    return _split(t).select("doc_id", "lang", "bucket", "words", "split")


@query(_SPLIT + " SELECT split, count(*) AS n, count(DISTINCT doc_id) AS ids, count(DISTINCT lang || bucket) AS cells, round(avg(words), 4) AS mean FROM s GROUP BY split")
def split_checks(t):
    """Counts by which the splits can be proved whole and apart."""
    return _split(t).groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"), F.countDistinct(F.concat("lang", "bucket")).alias("cells"), F.round(F.avg("words"), 4).alias("mean"))


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents)
SELECT doc_id, CASE WHEN len(w) <= 40 THEN array_to_string(w, ' ') ELSE array_to_string(list_slice(w, doc_id % (len(w) - 39) + 1, doc_id % (len(w) - 39) + 40), ' ') END AS win FROM w""")
def word_windows(t):
    """A run of forty words of each document, its start chosen by the id."""
    w = t.documents.select("doc_id", F.regexp_extract_all("text", F.lit(r"(\S+)"), F.lit(1)).alias("w"))
    start = (F.col("doc_id") % F.greatest(F.size("w") - 39, F.lit(1)) + 1).cast("int")
    return w.select("doc_id", F.when(F.size("w") <= 40, F.array_join("w", " ")).otherwise(F.array_join(F.slice("w", start, 40), " ")).alias("win"))


@query(_SIZED + """, q AS (SELECT doc_id, lang, bucket, row_number() OVER (PARTITION BY lang, bucket ORDER BY abs(words - CASE bucket WHEN 'short' THEN 350 WHEN 'medium' THEN 700 ELSE 1000 END), doc_id) AS rn FROM d)
SELECT doc_id, lang, bucket, CAST(rn AS INTEGER) AS rn FROM q WHERE rn <= CASE bucket WHEN 'short' THEN 4 WHEN 'medium' THEN 14 ELSE 2 END""")
def quota_fill(t):
    """The rows nearest to each bucket's target length, up to its quota."""
    target = F.when(F.col("bucket") == "short", 350).when(F.col("bucket") == "medium", 700).otherwise(1000)
    quota = F.when(F.col("bucket") == "short", 4).when(F.col("bucket") == "medium", 14).otherwise(2)
    rn = F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(F.abs(F.col("words") - target), "doc_id"))
    return sized(t.documents).withColumn("rn", rn).where(F.col("rn") <= quota).select("doc_id", "lang", "bucket", "rn")


@query("SELECT doc_id, n_chars, length(text[1:1000]) AS kept, CAST(len(list_slice(string_split(text, ' '), 1, 120)) AS INTEGER) AS words FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def longest_capped(t):
    """The ten longest documents, capped."""
    top = t.documents.orderBy(F.desc("n_chars"), "doc_id").limit(10)
    return top.select("doc_id", "n_chars", F.length(F.left("text", F.lit(1000))).cast("long").alias("kept"), F.size(F.slice(F.split("text", " "), 1, 120)).alias("words"))
