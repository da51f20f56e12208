"""Queries that rank and look along ordered rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators import ranking as R
from lectern.plans.registry import query

_RUNS = """WITH o AS (SELECT o_custkey AS candidate, o_orderkey, o_totalprice / 1000 AS score, CAST(o_orderkey % 7 AS BIGINT) AS risk, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS epoch FROM orders)"""


def runs(t):
    """Orders as evaluation rows: candidate, epoch, score, risk."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select(F.col("o_custkey").alias("candidate"), "o_orderkey", (F.col("o_totalprice") / 1000).alias("score"), (F.col("o_orderkey") % 7).alias("risk"), F.row_number().over(w).alias("epoch"))


@query(_RUNS + " SELECT candidate, CAST(epoch AS INTEGER) AS epoch, round(score, 6) AS score FROM o QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY risk, score DESC, epoch) = 1")
def best_per_candidate(t):
    """The best epoch of each candidate: least risk, then score, then the earliest."""
    b = R.best_per_group(runs(t), ["candidate"], [-F.col("risk"), F.col("score"), -F.col("epoch")], ["epoch", "score"])
    return b.withColumn("score", F.round("score", 6))


@query("SELECT s_suppkey, s_acctbal, CAST(row_number() OVER (ORDER BY s_acctbal DESC NULLS LAST, s_suppkey) AS INTEGER) AS rank FROM supplier QUALIFY rank <= 25")
def leaderboard(t):
    """The 25 highest scores."""
    return R.leaders(t.supplier.select("s_suppkey", "s_acctbal"), "s_acctbal", F.col("s_suppkey"), most=25)


_SUMS = "WITH s AS (SELECT l_suppkey AS candidate, count(*) AS parsed, avg(l_extendedprice) AS score, CAST(l_suppkey % 5 AS BIGINT) AS severe FROM lineitem GROUP BY l_suppkey)"


@query(_SUMS + """, h AS (SELECT * FROM s WHERE severe = 0 AND parsed >= 500), r AS (SELECT count(DISTINCT candidate) AS n FROM h WHERE parsed >= 600)
SELECT candidate, round(score, 6) AS score, parsed, CAST(row_number() OVER (ORDER BY round(score, 6) DESC, parsed DESC, candidate) AS INTEGER) AS rank FROM h, r WHERE n < 2 OR parsed >= 600""")
def tier_rank(t):
    """Preferred tier if two reach it, else the relaxed one."""
    s = t.lineitem.groupBy(F.col("l_suppkey").alias("candidate")).agg(F.count("*").alias("parsed"), F.round(F.avg("l_extendedprice"), 6).alias("score"))
    return R.tiered(s.withColumn("severe", F.col("candidate") % 5), "candidate", "parsed", "score", "severe", 600, 500)


@query(_RUNS + """, b AS (SELECT candidate, epoch AS be, score AS bs, risk AS br, last FROM (SELECT *, max(epoch) OVER (PARTITION BY candidate) AS last FROM o) QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY score DESC, epoch) = 1)
SELECT candidate, bool_or(epoch > be AND (bs - score >= 3.0 OR risk - br >= 3)) AS overfit, max(be) = max(last) AS ends_best, max(bs) > max(CASE WHEN epoch = last - 1 THEN score END) AS above_previous FROM o JOIN b USING (candidate) GROUP BY candidate""")
def overfit_flags(t):
    """Whether scores fall after the best epoch, and whether they still rise at the end."""
    return R.overfit(runs(t), ["candidate"], "epoch", "score", "risk")


@query(_RUNS + " SELECT candidate, o_orderkey, round(max(score) OVER (PARTITION BY candidate) - score, 6) AS gap, round(max(score) OVER (PARTITION BY candidate) - score, 6) <= 50 AS close FROM o")
def leader_gap(t):
    """Distance to the leader."""
    return R.gap_to_leader(runs(t), ["candidate"], "score", 50.0).select("candidate", "o_orderkey", "gap", "close")


@query(_RUNS + " SELECT candidate, o_orderkey, score > lag(score) OVER w AS rising, CAST(sum(CAST(round(score * 100000) AS BIGINT)) OVER w AS BIGINT) AS running FROM o WINDOW w AS (PARTITION BY candidate ORDER BY epoch)")
def rising_scores(t):
    """Comparison with the epoch before, and running totals."""
    w = Window.partitionBy("candidate").orderBy("epoch")
    return runs(t).select("candidate", "o_orderkey", (F.col("score") > F.lag("score").over(w)).alias("rising"), F.sum(F.round(F.col("score") * 100000).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("running"))


@query("""WITH g AS (SELECT user_id, event_id, value, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS module FROM events)
SELECT user_id, CAST(module AS BIGINT) AS module, count(*) AS rows, min(event_id) AS first_row, max(event_id) AS last_row, round(sum(value), 6) AS total FROM g WHERE module > 0 GROUP BY user_id, module""")
def gaps_islands_modules(t):
    """Rows from one boundary to the next, those before the first boundary dropped."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    g = t.events.withColumn("module", F.sum(F.when(F.col("event_type") == "view", 1).otherwise(0)).over(w)).where("module > 0")
    return g.groupBy("user_id", "module").agg(F.count("*").alias("rows"), F.min("event_id").alias("first_row"), F.max("event_id").alias("last_row"), F.round(F.sum("value"), 6).alias("total"))


@query("""WITH l AS (SELECT doc_id, generate_subscripts(s, 1) AS pos, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
k AS (SELECT doc_id, pos, line, lag(trim(lower(line))) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM l)
SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE before IS NULL OR before <> trim(lower(line))) AS kept FROM k GROUP BY doc_id""")
def consecutive_duplicates(t):
    """Lines that differ from the line before."""
    l = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    before = F.lag(F.trim(F.lower("line"))).over(Window.partitionBy("doc_id").orderBy("pos"))
    l = l.withColumn("before", before)
    return l.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(F.col("before").isNull() | (F.col("before") != F.trim(F.lower("line")))).alias("kept"))


@query("""WITH l AS (SELECT doc_id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))
SELECT doc_id, CAST(pos // 4 AS BIGINT) AS block, count(*) AS sentences, CAST(sum(len(regexp_extract_all(line, '\\S+'))) AS BIGINT) AS words FROM l GROUP BY ALL""")
def sentence_blocks(t):
    """Blocks of four lines."""
    l = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return l.groupBy("doc_id", F.floor(F.col("pos") / 4).alias("block")).agg(F.count("*").alias("sentences"), F.sum(F.regexp_count("line", F.lit(r"\S+"))).alias("words"))


@query("""WITH a AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, lead(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) OVER (ORDER BY vec_id) AS f, lead(vec_id) OVER (ORDER BY vec_id) AS next_id FROM embeddings)
SELECT vec_id, next_id, round(list_dot_product(e, f) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(f, f))), 6) AS similarity FROM a WHERE next_id IS NOT NULL""")
def dense_adjacent_cosine(t):
    """Cosine of neighbouring vectors: an equi-join on a running number, not a window over all rows."""
    from lectern.operators.sequences import adjacent_pairs

    return adjacent_pairs(t.embeddings.select("vec_id", "embedding"), "vec_id", "embedding")
