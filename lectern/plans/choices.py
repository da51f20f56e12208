"""Queries whose choices depend on earlier ones: unlike titles, refilled quotas, repaired splits, median picks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators import greedy as G
from lectern.operators import sampling as S
from lectern.plans.aggregates import _SIZED, sized
from lectern.plans.joins import TITLE_STOP
from lectern.plans.registry import query

_STOP = ", ".join(f"'{w}'" for w in TITLE_STOP)


@query(f"""WITH RECURSIVE w AS (SELECT doc_id, lang, list_sort(list_distinct(list_filter(regexp_extract_all(lower(string_split(text, chr(10))[1]), '[a-z0-9]+'), lambda x: length(x) > 2 AND NOT list_contains([{_STOP}], x)))) AS w FROM documents),
p AS (SELECT b.doc_id AS y, list(a.doc_id ORDER BY a.doc_id) AS near FROM w a JOIN w b ON a.lang = b.lang AND a.doc_id < b.doc_id AND len(list_intersect(a.w, b.w)) >= 3 AND CAST(len(list_intersect(a.w, b.w)) AS DOUBLE) / len(list_distinct(list_concat(a.w, b.w))) >= 0.5 GROUP BY b.doc_id),
o AS (SELECT y, near, row_number() OVER (ORDER BY y) AS i FROM p),
r(i, gone) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT o.i, CASE WHEN len(list_filter(near, lambda x: NOT list_contains(gone, x))) > 0 THEN list_append(gone, y) ELSE gone END FROM r JOIN o ON o.i = r.i + 1),
z AS (SELECT gone FROM r ORDER BY i DESC LIMIT 1)
SELECT w.doc_id, w.lang, coalesce(NOT list_contains(gone, w.doc_id), true) AS taken, CASE WHEN list_contains(gone, w.doc_id) THEN list_min(list_filter(near, lambda x: NOT list_contains(gone, x))) END AS by FROM w CROSS JOIN z LEFT JOIN p ON p.y = w.doc_id""")
def unlike_titles(t):
    """Documents taken in order unless the first line is like that of one taken before in the language."""
    d = t.documents.select("doc_id", "lang", F.substring_index("text", "\n", 1).alias("title"))
    return G.unlike_titles(d, "doc_id", "lang", "title", TITLE_STOP, 0.5)


_CELLS = _SIZED + """, c AS (SELECT lang, bucket, count(*) AS n, CASE bucket WHEN 'short' THEN 30 WHEN 'medium' THEN 30 WHEN 'long' THEN 20 ELSE 5 END AS target FROM d GROUP BY ALL)"""
_FILLED = _CELLS + """, o AS (SELECT *, least(n, target) AS own, n - least(n, target) AS spare, CASE bucket WHEN 'medium' THEN 1 WHEN 'long' THEN 2 WHEN 'short' THEN 3 ELSE 4 END AS p FROM c),
l AS (SELECT *, sum(target - own) OVER (PARTITION BY lang) AS lack, row_number() OVER (PARTITION BY lang ORDER BY p) AS k FROM o),
q(lang, k, lack, allocation, bucket) AS (SELECT lang, CAST(0 AS BIGINT), any_value(lack), CAST(0 AS BIGINT), '' FROM l GROUP BY lang
  UNION ALL SELECT l.lang, l.k, q.lack - least(q.lack, l.spare), CAST(l.own + least(q.lack, l.spare) AS BIGINT), l.bucket FROM q JOIN l ON l.lang = q.lang AND l.k = q.k + 1)"""


def _cells(t):
    b = F.col("bucket")
    n = sized(t.documents).groupBy("lang", "bucket").agg(F.count("*").alias("n"))
    n = n.withColumn("target", F.when(b.isin("short", "medium"), 30).when(b == "long", 20).otherwise(5))
    priority = F.when(b == "medium", 1).when(b == "long", 2).when(b == "short", 3).otherwise(4)
    return G.refilled_quota(n, ["lang"], priority, "n", "target")


@query(_FILLED.replace("WITH ", "WITH RECURSIVE ", 1) + " SELECT q.lang, q.bucket, n, target, allocation FROM q JOIN c ON c.lang = q.lang AND c.bucket = q.bucket")
def refilled_quota(t):
    """What each bucket of a language gives to its target, what is lacking spread by priority."""
    return _cells(t)


@query(_FILLED.replace("WITH ", "WITH RECURSIVE ", 1) + """, k AS (SELECT doc_id, d.lang, d.bucket, words, row_number() OVER (PARTITION BY d.lang, d.bucket ORDER BY words, doc_id) AS rank, allocation FROM d JOIN q ON q.lang = d.lang AND q.bucket = d.bucket)
SELECT doc_id, lang, bucket, words, rank FROM k WHERE rank <= allocation""")
def quota_picks(t):
    """The shortest documents of each cell, as many as the refilled quota says."""
    return G.first_of_cells(sized(t.documents).select("doc_id", "lang", "bucket", "words"), ["lang", "bucket"], ["words", "doc_id"], _cells(t))


_SHARED = _SIZED + """, c AS (SELECT lang, bucket, count(*) AS n FROM d GROUP BY ALL), h AS (SELECT *, sum(n) OVER (PARTITION BY lang) * 3 // 5 AS tv, sum(n) OVER (PARTITION BY lang) - sum(n) OVER (PARTITION BY lang) * 3 // 5 AS tt FROM c),
i AS (SELECT *, tv * CAST(n AS DOUBLE) / (tv + tt) AS iv, tt * CAST(n AS DOUBLE) / (tv + tt) AS it FROM h), f AS (SELECT *, least(floor(iv), n) AS fv, least(floor(it), n) AS ft FROM i),
a AS (SELECT lang, bucket, n, CAST(least(fv + CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY round(iv - floor(iv), 9) DESC, bucket) <= tv - sum(fv) OVER (PARTITION BY lang) THEN 1 ELSE 0 END, n) AS BIGINT) AS v, CAST(least(ft + CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY round(it - floor(it), 9) DESC, bucket) <= tt - sum(ft) OVER (PARTITION BY lang) THEN 1 ELSE 0 END, n) AS BIGINT) AS t FROM f),
g AS (SELECT lang, list(bucket ORDER BY bucket) AS b, list(n ORDER BY bucket) AS n, list(v + CASE WHEN bucket = 'short' THEN 1 ELSE 0 END ORDER BY bucket) AS v, list(t ORDER BY bucket) AS t FROM a GROUP BY lang),
s(lang, b, n, v, t, moved, i) AS (SELECT lang, b, n, v, t, CAST(0 AS BIGINT), coalesce(list_position(list_transform(range(1, len(n) + 1), lambda k: v[k] + t[k] > n[k]), true), 0) FROM g UNION ALL
  SELECT lang, b, n, nv, nt, moved + 1, coalesce(list_position(list_transform(range(1, len(n) + 1), lambda k: nv[k] + nt[k] > n[k]), true), 0) FROM (
    SELECT *, list_transform(v, lambda x, k: CASE WHEN tst THEN x WHEN k = i THEN x - 1 WHEN k = j THEN x + 1 ELSE x END) AS nv, list_transform(t, lambda x, k: CASE WHEN NOT tst THEN x WHEN k = i THEN x - 1 WHEN k = j THEN x + 1 ELSE x END) AS nt FROM (
      SELECT *, CASE WHEN t[i] >= v[i] THEN t[i] > 0 ELSE v[i] = 0 END AS tst, list_position(list_transform(range(1, len(n) + 1), lambda k: k <> i AND v[k] + t[k] < n[k]), true) AS j FROM s WHERE i > 0) WHERE j > 0)),
e AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang ORDER BY moved DESC) = 1)"""


@query(_SHARED.replace("WITH ", "WITH RECURSIVE ", 1) + " SELECT lang, unnest(b) AS bucket, unnest(n) AS n, CASE WHEN i = 0 THEN unnest(v) ELSE unnest((SELECT any_value(g.v) FROM g WHERE g.lang = e.lang)) END AS val, CASE WHEN i = 0 THEN unnest(t) ELSE unnest((SELECT any_value(g.t) FROM g WHERE g.lang = e.lang)) END AS test, CASE WHEN i = 0 THEN moved END AS moved FROM e")
def repaired_splits(t):
    """Validation and test rows of each cell, of which some ask for more than there are, moved to cells with rows left."""
    w = Window.partitionBy("lang")
    c = sized(t.documents).groupBy("lang", "bucket").agg(F.count("*").alias("n"))
    c = c.withColumn("all", F.sum("n").over(w)).withColumn("tv", F.floor(F.col("all") * 3 / 5)).withColumn("tt", F.col("all") - F.col("tv"))
    c = S.largest_remainder(c, ["lang"], "bucket", "n", "tv").withColumnRenamed("allocation", "val")
    c = S.largest_remainder(c, ["lang"], "bucket", "n", "tt").withColumnRenamed("allocation", "test")
    c = c.select("lang", "bucket", "n", (F.col("val") + (F.col("bucket") == "short").cast("long")).alias("val"), "test")
    return G.without_overdraw(c, ["lang"], F.col("bucket"), "n", "val", "test")


PLAN = [(lang, bucket) for bucket in ("medium", "long", "short") for lang in ("de", "en", "es", "fr")][:10]
_PLAN = ", ".join(f"({i}, '{d}', '{b}')" for i, (d, b) in enumerate(PLAN))


@query(_SIZED.replace("WITH ", "WITH RECURSIVE ", 1) + f""", plan(i, lang, bucket) AS (VALUES {_PLAN}), o AS (SELECT * FROM d WHERE bucket <> 'long'),
one AS (SELECT lang, bucket, list(doc_id ORDER BY words, doc_id) AS l FROM o GROUP BY ALL), two AS (SELECT lang, list(doc_id ORDER BY words, doc_id) AS l FROM o GROUP BY ALL), three AS (SELECT bucket, list(doc_id ORDER BY words, doc_id) AS l FROM o GROUP BY ALL), four AS (SELECT list(doc_id ORDER BY words, doc_id) AS l FROM o),
x AS (SELECT plan.*, coalesce(one.l, []) AS l1, coalesce(two.l, []) AS l2, coalesce(three.l, []) AS l3, coalesce(four.l, []) AS l4 FROM plan LEFT JOIN one ON one.lang = plan.lang AND one.bucket = plan.bucket LEFT JOIN two ON two.lang = plan.lang LEFT JOIN three ON three.bucket = plan.bucket CROSS JOIN four),
r(i, used, lang, bucket, level) AS (SELECT -1, CAST([] AS BIGINT[]), '', '', '' UNION ALL SELECT i, CASE WHEN len(u) > 0 THEN list_append(used, u[len(u) // 2 + 1]) ELSE used END, lang, bucket, CASE WHEN len(u1) > 0 THEN 'cell' WHEN len(u2) > 0 THEN 'domain' WHEN len(u3) > 0 THEN 'bucket' WHEN len(u4) > 0 THEN 'any' END FROM (
  SELECT *, CASE WHEN len(u1) > 0 THEN u1 WHEN len(u2) > 0 THEN u2 WHEN len(u3) > 0 THEN u3 ELSE u4 END AS u FROM (
    SELECT x.i, used, x.lang, x.bucket, list_filter(l1, lambda k: NOT list_contains(used, k)) AS u1, list_filter(l2, lambda k: NOT list_contains(used, k)) AS u2, list_filter(l3, lambda k: NOT list_contains(used, k)) AS u3, list_filter(l4, lambda k: NOT list_contains(used, k)) AS u4 FROM r JOIN x ON x.i = r.i + 1)))
SELECT lang, bucket, used[-1] AS doc_id, level FROM r WHERE i >= 0""")
def median_picks(t):
    """A document for each cell of a plan: the median of those not picked yet, with fallbacks as no long ones are left."""
    d = sized(t.documents).where("bucket <> 'long'")
    picks = G.median_picks(d.select("doc_id", "lang", "bucket", "words"), PLAN, "lang", "bucket", "doc_id", ["words", "doc_id"])
    return t.spark.createDataFrame(picks, "lang string, bucket string, doc_id long, level string")
