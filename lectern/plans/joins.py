"""Queries that join, reconcile, deduplicate."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import reconcile as R
from lectern.plans.registry import query

# fixed values: words that say nothing about a title's topic
TITLE_STOP = ["a", "an", "and", "about", "academic", "active", "all", "analysis", "analytical", "analyze", "approximately", "authoritative", "body", "can", "coherent", "comprehensive", "complex", "complete", "create", "critical", "detailed", "draft", "essay", "for", "formal", "full", "help", "highly", "in", "include", "including", "informative", "introduction", "language", "literary", "me", "methodology", "of", "on", "organized", "paper", "please", "polished", "prepare", "presentation", "proposal", "provide", "references", "report", "research", "section", "sentence", "sentences", "single", "structures", "support", "the", "thesis", "tone", "transition", "using", "verbatim", "with", "words", "write", "writing"]


@query("SELECT kind, n FROM (SELECT count(*) FILTER (WHERE a AND r) AS overlap, count(*) FILTER (WHERE e AND NOT a AND NOT r) AS missing, count(*) FILTER (WHERE NOT e) AS unexpected, count(*) FILTER (WHERE a) AS accepted, count(*) FILTER (WHERE r) AS rejected FROM (SELECT doc_id, bool_or(k = 'e') AS e, bool_or(k = 'a') AS a, bool_or(k = 'r') AS r FROM (SELECT doc_id, 'e' AS k FROM documents UNION ALL SELECT doc_id, 'a' FROM labels WHERE quality = 1 AND toxic = 0 UNION ALL SELECT doc_id, 'r' FROM labels WHERE NOT (quality = 1 AND toxic = 0)) GROUP BY doc_id)) UNPIVOT (n FOR kind IN (overlap, missing, unexpected, accepted, rejected))")
def coverage(t):
    """Overlap, missing and unexpected ids of accepted and rejected rows."""
    ok = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return R.coverage(t.documents.select("doc_id"), t.labels.where(ok).select("doc_id"), t.labels.where(~ok).select("doc_id"), "doc_id")


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def missing_ids(t):
    """Ids without a label, by set difference."""
    return t.documents.select("doc_id").subtract(t.labels.select("doc_id"))


@query("SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels")
def common_ids(t):
    """Ids in both of two sets."""
    return t.documents.where("lang = 'en'").select("doc_id").intersect(t.labels.select("doc_id"))


@query("SELECT o_custkey AS id FROM orders UNION SELECT c_custkey FROM customer UNION SELECT user_id FROM events")
def all_ids(t):
    """Union of three id columns."""
    return t.orders.select(F.col("o_custkey").alias("id")).union(t.customer.select("c_custkey")).union(t.events.select("user_id")).distinct()


@query("SELECT CASE WHEN l.o_orderkey IS NULL THEN 'right_only' WHEN r.o_orderkey IS NULL THEN 'left_only' WHEN l.o_custkey IS NOT DISTINCT FROM r.o_custkey AND l.o_orderstatus IS NOT DISTINCT FROM r.s THEN 'matched' ELSE 'differs' END AS status, count(*) AS n FROM (SELECT * FROM orders WHERE o_orderpriority <> '1-URGENT') l FULL JOIN (SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice > 200000 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderpriority <> '5-LOW') r USING (o_orderkey) GROUP BY 1")
def alignment(t):
    """Two copies of a table side by side: matched, differing and one-sided rows."""
    left = t.orders.where("o_orderpriority <> '1-URGENT'")
    right = t.orders.where("o_orderpriority <> '5-LOW'").withColumn("o_orderstatus", F.when(F.col("o_totalprice") > 200_000, "X").otherwise(F.col("o_orderstatus")))
    return R.align(left, right, "o_orderkey", ["o_custkey", "o_orderstatus"])


@query("SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def labels_with_default(t):
    """Left lookup with defaults for absent rows."""
    return R.with_default(t.documents.select("doc_id"), t.labels, "doc_id", {"quality": -1, "toxic": -1})


@query("SELECT o_orderkey AS key, CASE WHEN o_orderstatus = 'O' AND o_totalprice <= 100000 THEN 'NEW' ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')")
def upsert_keep(t):
    """Upsert: blank new values don't overwrite old ones, absent keys are added."""
    old = t.orders.where("o_orderstatus in ('F', 'O')").select(F.col("o_orderkey").alias("key"), "o_orderpriority")
    value = F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).when(F.col("o_totalprice") > 100_000, " ").otherwise("NEW")
    new = t.orders.where("o_orderstatus in ('O', 'P')").select(F.col("o_orderkey").alias("key"), value.alias("o_orderpriority"))
    return R.merge_keep(old, new, "key", ["o_orderpriority"])


@query("SELECT c_custkey, c_name, n_name, r_name, coalesce(orders, 0) AS orders, round(coalesce(total, 0), 2) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS orders, sum(o_totalprice) AS total FROM orders GROUP BY 1) ON c_custkey = o_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def multi_join_assembly(t):
    """Several left joins; the large side is aggregated before it is joined."""
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("total"))
    j = t.customer.join(o, "c_custkey", "left").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return j.select("c_custkey", "c_name", "n_name", "r_name", F.coalesce("orders", F.lit(0)).alias("orders"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"))


@query("SELECT count(*) AS rows, count(DISTINCT l_orderkey) AS orders, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderpriority = '1-URGENT') AND NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size < 10)")
def semi_and_anti(t):
    """Rows with an urgent order and without a small part."""
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    small = t.part.where("p_size < 10").select(F.col("p_partkey").alias("l_partkey"))
    j = t.lineitem.join(urgent, "l_orderkey", "left_semi").join(small, "l_partkey", "left_anti")
    return j.agg(F.count("*").alias("rows"), F.countDistinct("l_orderkey").alias("orders"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("WITH r AS (SELECT s_suppkey AS id, s_suppkey * 500 AS lo, s_suppkey * 500 + 120 AS hi FROM supplier) SELECT id, l_orderkey, l_linenumber, l_quantity FROM lineitem JOIN r ON l_orderkey BETWEEN lo AND hi")
def range_extract(t):
    """Rows of stored ranges: both sides are cut in cells, so that ranges meet rows by equality."""
    from lectern.operators.ranges import range_join

    r = t.supplier.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 500).alias("lo"), (F.col("s_suppkey") * 500 + 120).alias("hi"))
    return range_join(t.lineitem, "l_orderkey", r, "lo", "hi", 256).select("id", "l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT digest, n, first_id FROM (SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1) WHERE n > 1")
def exact_dup_groups(t):
    """Texts that occur more than once."""
    return t.documents.groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))")
def signature_dedup(t):
    """First document of each normalised text."""
    return R.first_seen(t.documents.select("doc_id", "text"), R.signature(F.col("text")), "doc_id", ["doc_id"])


@query("SELECT source, count(*) AS n, count(DISTINCT sha256(text)) AS texts FROM documents GROUP BY source HAVING count(*) > count(DISTINCT sha256(text))")
def duplicate_sources(t):
    """Sources that hold a text twice."""
    g = t.documents.select("source", F.sha2("text", 256).alias("h")).groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("h").alias("texts"))
    return g.where("n > texts")


@query("""WITH l AS (SELECT doc_id, lower(trim(line)) AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE len(regexp_extract_all(line, '\\S+')) >= 10)
SELECT doc_id, count(*) AS long_lines, count(DISTINCT k) AS distinct_lines FROM l GROUP BY doc_id""")
def sentence_dedup(t):
    """Long lines of a document, and how many are distinct."""
    l = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.regexp_count("line", F.lit(r"\S+")) >= 10)
    return l.groupBy("doc_id").agg(F.count("*").alias("long_lines"), F.countDistinct(F.md5(F.lower(F.trim("line")))).alias("distinct_lines"))


_TITLES = "SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(string_split(text, chr(10))[1]), '[a-z0-9]+'), lambda x: length(x) > 2 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in TITLE_STOP) + "], x)))) AS w FROM documents"


@query(f"""WITH d AS (SELECT w, min(doc_id) AS doc_id FROM ({_TITLES}) WHERE len(w) >= 3 GROUP BY w)
SELECT a.doc_id AS x, b.doc_id AS y, round(CAST(len(list_intersect(a.w, b.w)) AS DOUBLE) / len(list_distinct(list_concat(a.w, b.w))), 9) AS similarity FROM d a JOIN d b ON a.doc_id < b.doc_id WHERE len(list_intersect(a.w, b.w)) >= 3 AND CAST(len(list_intersect(a.w, b.w)) AS DOUBLE) / len(list_distinct(list_concat(a.w, b.w))) >= 0.8""")
def near_title_pairs(t):
    """Documents whose first lines share most of their words."""
    d = t.documents.select("doc_id", F.split("text", "\n")[0].alias("title"))
    return R.near_title_pairs(d, "doc_id", "title", TITLE_STOP)


@query(f"SELECT doc_id, min(doc_id) OVER (PARTITION BY w) AS representative FROM ({_TITLES}) WHERE len(w) >= 3")
def near_title_classes(t):
    """Documents with the one that stands for their first line's words in near_title_pairs."""
    d = t.documents.select("doc_id", F.split("text", "\n")[0].alias("title"))
    return R.title_classes(d, "doc_id", "title", TITLE_STOP)


@query("""WITH w AS (SELECT source, doc_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z''-]*')) AS term FROM documents), f AS (SELECT source, doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
v AS (SELECT source, doc_id, term, tf / CAST(sum(tf) OVER (PARTITION BY source, doc_id) AS DOUBLE) * (ln((1 + docs) / CAST(1 + count(*) OVER (PARTITION BY source, term) AS DOUBLE)) + 1) AS x FROM f JOIN (SELECT source, count(*) AS docs FROM documents GROUP BY source) USING (source)),
n AS (SELECT source, doc_id, sqrt(sum(x * x)) AS norm FROM v GROUP BY ALL), p AS (SELECT source, doc_id, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS next_id FROM documents),
d AS (SELECT p.source, p.doc_id, sum(a.x * b.x) AS dot FROM p JOIN v a ON a.doc_id = p.doc_id JOIN v b ON b.doc_id = p.next_id AND a.term = b.term GROUP BY ALL)
SELECT p.source, p.doc_id, next_id, round(coalesce(dot / (a.norm * b.norm), 0), 6) AS similarity FROM p LEFT JOIN d USING (source, doc_id) LEFT JOIN n a ON a.doc_id = p.doc_id LEFT JOIN n b ON b.doc_id = p.next_id WHERE next_id IS NOT NULL""")
def tfidf_adjacent_cosine(t):
    """Cosine of neighbouring documents of a source."""
    return R.tfidf_adjacent(t.documents.select("source", "doc_id", "text"), "source", "doc_id")


@query("SELECT a.conv_id, count(*) AS pairs, count(*) FILTER (WHERE a.role = b.role) AS same_role FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn GROUP BY a.conv_id")
def pairs_within(t):
    """Pairs of items within a record: counted from role counts, so that no pair is made."""
    n = t.conversations.groupBy("conv_id", "role").agg(F.count("*").alias("n"))
    g = n.groupBy("conv_id").agg(F.sum("n").alias("all"), F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("same_role"))
    return g.select("conv_id", (F.col("all") * (F.col("all") - 1) / 2).cast("long").alias("pairs"), "same_role").where("pairs > 0")
