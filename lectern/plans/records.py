"""Queries over records: projections, filters, selection, casts, parsing, classification."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as X
from lectern.operators import reconcile as R
from lectern.operators import sampling as S
from lectern.operators import selection as L
from lectern.plans.aggregates import _SIZED, sized
from lectern.plans.registry import query


@query("SELECT doc_id, regexp_matches(lower(text), '(?:^|[^a-z0-9_])(?:the|and)(?:$|[^a-z0-9_])') AS any_word, regexp_matches(lower(text), '(?:^|[^a-z0-9_])the(?:$|[^a-z0-9_])') AND regexp_matches(lower(text), '(?:^|[^a-z0-9_])of\\s+the(?:$|[^a-z0-9_])') AS every_word FROM documents")
def keyword_filters(t):
    """Any and every keyword between word edges."""
    c = F.col("text")
    return t.documents.select("doc_id", L.keyword_match(c, ["the", "and"]).alias("any_word"), L.keyword_match(c, ["the", "of the"], every=True).alias("every_word"))


@query("""WITH r AS (SELECT source, doc_id, CASE WHEN lang NOT IN ('en', 'de') THEN 'language' WHEN trim(text) = '' THEN 'empty' WHEN row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 THEN 'seen' END AS reason FROM documents)
SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM r GROUP BY 1""")
def skip_reasons(t):
    """Why rows are skipped: language, empty, seen before."""
    h = t.documents.select("doc_id", "lang", (F.trim("text") == "").alias("blank"), F.sha2("text", 256).alias("h"))
    first = h.groupBy("h").agg(F.min("doc_id").alias("first"))
    reason = F.when(~F.col("lang").isin("en", "de"), "language").when(F.col("blank"), "empty").when(F.col("doc_id") != F.col("first"), "seen").otherwise("kept")
    return h.join(first, "h").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pair_index, doc_id, sha256(text) AS stable_hash, lang || ':' || sha256(text)[1:12] AS record_id, length(text) AS chars FROM documents")
def record_manifest(t):
    """Dense index, digest and id of each record, without text; numbered by many tasks."""
    from lectern.operators.sequences import number_rows

    d = t.documents.select("doc_id", F.sha2("text", 256).alias("stable_hash"), "lang", F.length("text").cast("long").alias("chars"))
    d = d.withColumn("record_id", F.concat("lang", F.lit(":"), F.left("stable_hash", F.lit(12))))
    return number_rows(d, ["doc_id"], name="pair_index").select("pair_index", "doc_id", "stable_hash", "record_id", "chars")


@query("SELECT f.lang, f.doc_id, p.doc_id AS replacement FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents JOIN labels USING (doc_id) WHERE quality = 0) f LEFT JOIN (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND n_chars > 3000) p USING (lang, n)")
def positional_replacement(t):
    """The n-th failed row of each language takes the n-th spare one."""
    d = t.documents.select("doc_id", "lang", "n_chars")
    judged = d.join(t.labels, "doc_id")
    spare = d.join(t.labels, "doc_id", "left_anti").where("n_chars > 3000")
    return L.replace_failed(judged, spare, "lang", "doc_id", F.col("quality") == 0)


@query(_SIZED + """, f AS (SELECT *, row_number() OVER (PARTITION BY source, bucket ORDER BY doc_id) AS k FROM d), r AS (SELECT *, CASE WHEN k = 1 THEN CASE bucket WHEN 'long' THEN 1 WHEN 'short' THEN 2 ELSE 3 END ELSE 4 END AS rank FROM f)
SELECT source, doc_id, bucket, CAST(row_number() OVER (PARTITION BY source ORDER BY rank, doc_id) AS INTEGER) AS pick FROM r QUALIFY pick <= 2""")
def review_candidates(t):
    """Two rows of each source for review, long ones first."""
    return L.first_by_priority(sized(t.documents), "source", "bucket", ["long", "short", "medium"], "doc_id", 2).select("source", "doc_id", "bucket", "pick")


@query("SELECT doc_id, quality, toxic FROM labels ORDER BY CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN 1 ELSE 2 END, quality, doc_id LIMIT 12")
def problem_examples(t):
    """The twelve worst rows."""
    severity = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    return t.labels.orderBy(severity, "quality", "doc_id").limit(12)


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 7")
def limit_per_source(t):
    """The first seven rows of each source."""
    n = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return t.documents.select("source", "doc_id").withColumn("n", n).where("n <= 7").drop("n")


@query("SELECT c_nationkey, count(*) AS total, count(*) * 20 // 100 AS short, count(*) * 70 // 100 AS medium, count(*) - count(*) * 20 // 100 - count(*) * 70 // 100 AS long FROM customer GROUP BY c_nationkey")
def quota_split(t):
    """A total in shares of 20, 70 and the rest."""
    g = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("total"))
    return g.select("c_nationkey", "total", *[c.cast("long").alias(n) for n, c in L.quotas(F.col("total"), {"short": 20, "medium": 70}, "long").items()])


@query("""WITH l AS (SELECT doc_id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
w AS (SELECT doc_id, pos, CAST(len(regexp_extract_all(line, '\\S+')) AS BIGINT) AS words FROM l), r AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS e FROM w),
j AS (SELECT a.doc_id, a.pos AS first, b.pos AS last, b.e - a.e + a.words AS total FROM r a JOIN r b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.e - a.e + a.words BETWEEN 100 AND 200)
SELECT doc_id, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last, CAST(total AS BIGINT) AS total FROM j QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY abs(total - 150), first - last, first) = 1""")
def best_windows(t):
    """The run of lines of each document nearest to 150 words."""
    l = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    l = l.select("doc_id", "pos", F.regexp_count("line", F.lit(r"\S+")).cast("long").alias("words"))
    return L.best_window(l, "doc_id", "pos", "words", 100, 200, 150)


@query("""WITH s AS (SELECT doc_id, list_sort(list_transform([{'s': 4 * CAST(lang = 'en' AS INTEGER) + CAST(len(regexp_extract_all(text, 'th')) > 50 AS INTEGER) * 2, 'o': 0, 'n': 'english'}, {'s': 4 * CAST(lang = 'de' AS INTEGER) + CAST(len(regexp_extract_all(text, 'ch')) > 50 AS INTEGER) * 2, 'o': -1, 'n': 'german'}, {'s': 4 * CAST(lang IN ('fr', 'es') AS INTEGER), 'o': -2, 'n': 'romance'}], lambda x: x), 'DESC') AS t FROM documents)
SELECT doc_id, CASE WHEN t[1].s >= 1 AND t[1].s - t[2].s >= 4 THEN t[1].n END AS domain FROM s""")
def scored_domains(t):
    """Domain by scores, with a margin over the second."""
    many = lambda p: (F.regexp_count("text", F.lit(p)) > 50).cast("int")
    lang = lambda *v: F.col("lang").isin(*v).cast("int")
    scores = {"english": 4 * lang("en") + 2 * many("th"), "german": 4 * lang("de") + 2 * many("ch"), "romance": 4 * lang("fr", "es")}
    return t.documents.select("doc_id", L.classify(scores, 1, 4).alias("domain"))


@query("SELECT event_id, coalesce(TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT), -1) AS number, coalesce(TRY_CAST(event_type AS DOUBLE), 0.0) AS lenient, round(100.0 * user_id / (user_id + event_id + 1), 6) AS percent FROM events")
def lenient_casts(t):
    """Casts with defaults, and percents without division by zero."""
    return t.events.select("event_id", F.coalesce(F.regexp_extract("props", "([0-9]+)", 1).try_cast("bigint"), F.lit(-1)).alias("number"), F.coalesce(F.col("event_type").try_cast("double"), F.lit(0.0)).alias("lenient"), F.round(100.0 * F.col("user_id") / (F.col("user_id") + F.col("event_id") + 1), 6).alias("percent"))


@query("SELECT id, regexp_extract(id, '^(.*)_(phase[0-9]+)_epoch_([0-9]+)$', 1) AS candidate, regexp_extract(id, '^(.*)_(phase[0-9]+)_epoch_([0-9]+)$', 2) AS stage, CAST(regexp_extract(id, '^(.*)_(phase[0-9]+)_epoch_([0-9]+)$', 3) AS INTEGER) AS epoch FROM (SELECT 'model' || o_custkey || '_phase' || (o_orderkey % 3) || '_epoch_' || (o_orderkey % 5 + 1) AS id FROM orders)")
def system_ids(t):
    """Candidate, stage and epoch out of a system's id."""
    p = r"^(.*)_(phase[0-9]+)_epoch_([0-9]+)$"
    i = t.orders.select(F.concat(F.lit("model"), "o_custkey", F.lit("_phase"), F.col("o_orderkey") % 3, F.lit("_epoch_"), F.col("o_orderkey") % 5 + 1).alias("id"))
    return i.select("id", F.regexp_extract("id", p, 1).alias("candidate"), F.regexp_extract("id", p, 2).alias("stage"), F.regexp_extract("id", p, 3).cast("int").alias("epoch"))


@query("SELECT a.doc_id, CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1.0 WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE round(CAST(len(list_intersect(x, y)) AS DOUBLE) / len(list_distinct(list_concat(x, y))), 9) END AS similarity FROM (SELECT doc_id, list_distinct(regexp_extract_all(lower(string_split(text, chr(10))[1]), '[a-z0-9]+')) AS x, list_distinct(regexp_extract_all(lower(string_split(text, chr(10))[2]), '[a-z0-9]+')) AS y FROM documents WHERE contains(text, chr(10))) a")
def line_similarity(t):
    """Jaccard similarity of the first two lines."""
    words = lambda i: F.array_distinct(F.regexp_extract_all(F.lower(F.split("text", "\n")[i]), F.lit("([a-z0-9]+)"), F.lit(1)))
    return t.documents.where(F.contains("text", F.lit("\n"))).select("doc_id", F.round(R.jaccard(words(0), words(1)), 9).alias("similarity"))


@query("WITH l AS (SELECT text[1:40] AS label, doc_id, source FROM documents) SELECT label, count(DISTINCT source) AS sources, count(*) AS n FROM l GROUP BY label HAVING count(DISTINCT source) > 1")
def label_of_many_sources(t):
    """Labels that several sources share."""
    return t.documents.select(F.left("text", F.lit(40)).alias("label"), "source").groupBy("label").agg(F.countDistinct("source").alias("sources"), F.count("*").alias("n")).where("sources > 1")


@query("SELECT l_orderkey, l_linenumber, 1 - l_discount AS strength FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY 1 - l_discount DESC, l_linenumber) = 1")
def strongest_boundary(t):
    """The strongest boundary of each sentence, the first of equals."""
    key = F.struct(1 - F.col("l_discount"), -F.col("l_linenumber"))
    g = t.lineitem.groupBy("l_orderkey").agg(F.max_by(F.struct("l_linenumber", (1 - F.col("l_discount")).alias("strength")), key).alias("b"))
    return g.select("l_orderkey", "b.l_linenumber", "b.strength")


@query("SELECT conv_id, array_to_string(list((turn + 1) || '. ' || role || ' (' || length(text) || ')' ORDER BY turn, role, text), chr(10)) AS lines FROM conversations GROUP BY conv_id")
def rubric_lines(t):
    """Items of a list as numbered lines."""
    g = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("r"))
    line = lambda x: F.concat((x["turn"] + 1).cast("string"), F.lit(". "), x["role"], F.lit(" ("), F.length(x["text"]).cast("string"), F.lit(")"))
    return g.select("conv_id", F.array_join(F.transform("r", line), "\n").alias("lines"))


@query(_SIZED + " SELECT lang, count(*) AS n, max(words) AS longest, CAST(sum(words) AS BIGINT) AS total, round(100.0 * count(*) FILTER (WHERE words > 1200) / count(*), 6) AS truncated, count(*) FILTER (WHERE words > 1200) > count(*) * 0.05 AS fails FROM d GROUP BY lang")
def preflight_gate(t):
    """Whether too many texts of a language would be cut."""
    over = F.count_if(F.col("words") > 1200)
    g = sized(t.documents).groupBy("lang").agg(F.count("*").alias("n"), F.max("words").alias("longest"), F.sum("words").alias("total"), F.round(100.0 * over / F.count("*"), 6).alias("truncated"), (over > F.count("*") * 0.05).alias("fails"))
    return g


@query("SELECT doc_id, CASE WHEN words BETWEEN 250 AND 499 THEN 'short' WHEN words BETWEEN 500 AND 800 THEN 'medium' WHEN words BETWEEN 801 AND 1200 THEN 'long' END AS bucket, words <> n AS miscounted FROM (SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9]+(?:[''-][A-Za-z0-9]+)*')) AS BIGINT) AS words, CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT) AS n FROM documents)")
def sample_violations(t):
    """Bucket by words, and whether a stored count differs from the actual one."""
    d = t.documents.select("doc_id", X.word_count(F.col("text")).alias("words"), X.word_count(F.col("text"), "nonblank").alias("n"))
    return d.select("doc_id", X.excerpt_bucket(F.col("words")).alias("bucket"), (F.col("words") != F.col("n")).alias("miscounted"))


@query("SELECT c_custkey, o_orderkey, 'missing' AS status FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL UNION ALL SELECT c_custkey, max(o_orderkey), CASE WHEN max(o_totalprice) > 200000 THEN 'large' ELSE 'found' END FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def lookup_outcomes(t):
    """Left lookup with a reason for absent rows."""
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("o_orderkey"), F.max("o_totalprice").alias("top"))
    status = F.when(F.col("o_orderkey").isNull(), "missing").when(F.col("top") > 200000, "large").otherwise("found")
    return t.customer.select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", "o_orderkey", status.alias("status"))


@query("SELECT item_id, coalesce(n, 0) AS documents FROM benchmark LEFT JOIN (SELECT b.item_id, count(*) AS n FROM benchmark b JOIN documents d ON md5(lower(trim(string_split(b.text, chr(10))[1]))) = md5(lower(trim(string_split(d.text, chr(10))[1]))) GROUP BY b.item_id) USING (item_id)")
def benchmark_first_lines(t):
    """Documents that begin with a benchmark item's first line."""
    head = F.md5(F.lower(F.trim(F.split("text", "\n")[0])))
    n = t.documents.groupBy(head.alias("h")).agg(F.count("*").alias("documents"))
    b = t.benchmark.select("item_id", head.alias("h")).join(n, "h", "left")
    return b.select("item_id", F.coalesce("documents", F.lit(0)).alias("documents"))


@query("WITH m AS (SELECT user_id, map_from_entries(list({'k': event_type, 'v': n})) AS m FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id) SELECT user_id, e.k AS system, e.v AS n FROM (SELECT user_id, unnest(map_entries(m)) AS ev FROM m) x, LATERAL (SELECT ev.key AS k, ev.value AS v) e")
def map_rows(t):
    """Rows of a map column: systems of a summary, flattened."""
    g = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return g.select("user_id", F.explode("m").alias("system", "n"))


@query("SELECT doc_id, words FROM (SELECT doc_id, CAST(len(regexp_extract_all(text, '\\S+')) AS INTEGER) AS words FROM documents) ORDER BY sha256('7:' || doc_id), doc_id LIMIT 30")
def reservoir(t):
    """A reservoir of thirty rows, kept by hash order so that any number of tasks can share it."""
    d = t.documents.select("doc_id", X.word_count(F.col("text"), "nonblank").alias("words"))
    return S.simple_sample(d, 30, 7, "doc_id")


@query("WITH a AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, lead(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) OVER (PARTITION BY label ORDER BY vec_id) AS f FROM embeddings) SELECT label, vec_id AS after_id, round(1 - list_dot_product(e, f) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(f, f))), 6) AS strength FROM a WHERE f IS NOT NULL")
def topic_boundaries(t):
    """Boundary strength after each block: 1 less the cosine with the next one of its group."""
    from lectern.operators.sequences import cosine, number_rows

    d = number_rows(t.embeddings.select("label", "vec_id", "embedding"), ["vec_id"], ["label"], "n")
    nxt = d.select(F.col("label").alias("l2"), (F.col("n") - 1).alias("n2"), F.col("embedding").alias("f"))
    j = d.join(nxt, F.expr("label <=> l2 and n = n2"))
    return j.select("label", F.col("vec_id").alias("after_id"), F.round(1 - cosine(F.col("embedding"), F.col("f")), 6).alias("strength"))


@query("""WITH l AS (SELECT page_id, generate_subscripts(h, 1) AS pos, unnest(h) AS tag FROM (SELECT page_id, regexp_extract_all(html, '<(h[1-6]|p)>', 1) AS h FROM pages))
SELECT page_id, count(*) AS blocks, count(*) FILTER (WHERE tag <> 'p') AS headings, CAST(coalesce(sum(CASE WHEN pos > 1 AND tag IN ('h1', 'h2') THEN 1.5 WHEN pos > 1 AND tag <> 'p' THEN 1.2 ELSE 0 END), 0) AS DOUBLE) AS strength FROM l GROUP BY page_id""")
def heading_boundaries(t):
    """Boundaries before headings: 1.5 for the first two levels, else 1.2."""
    l = t.pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<(h[1-6]|p)>"), F.lit(1))).alias("pos", "tag"))
    strength = F.when((F.col("pos") > 0) & F.col("tag").isin("h1", "h2"), 1.5).when((F.col("pos") > 0) & (F.col("tag") != "p"), 1.2).otherwise(0.0)
    return l.groupBy("page_id").agg(F.count("*").alias("blocks"), F.count_if(F.col("tag") != "p").alias("headings"), F.sum(strength).alias("strength"))


@query("WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS k FROM documents) SELECT doc_id, CAST(len(k) AS INTEGER) AS points, md5(array_to_string(k, '|')) AS digest, k[1][1:60] AS overall FROM p")
def key_points(t):
    """Points stripped, blank ones dropped, and the first as the overall fallback."""
    k = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return t.documents.select("doc_id", k.alias("k")).select("doc_id", F.size("k").alias("points"), F.md5(F.array_join("k", "|")).alias("digest"), F.left(F.get("k", F.lit(0)), F.lit(60)).alias("overall"))


@query("SELECT c_custkey, '{\"name\":\"' || c_name || '\",\"segment\":\"' || c_mktsegment || '\",\"nation\":' || c_nationkey || '}' AS json FROM customer")
def compact_json(t):
    """Records as compact JSON with a fixed order of keys."""
    return t.customer.select("c_custkey", F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))).alias("json"))


@query("""WITH e AS (SELECT l_suppkey AS run, l_linenumber AS epoch, count(*) AS parsed, CAST(sum(l_orderkey % 3) AS BIGINT) AS failures FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY parsed DESC, failures, epoch) AS rn FROM e),
s AS (SELECT *, max(CASE WHEN rn = 2 THEN parsed END) OVER (PARTITION BY run) AS second FROM r)
SELECT run, epoch, parsed, failures, CAST(rn AS INTEGER) AS rank FROM s WHERE rn <= 2 OR (rn = 3 AND second - parsed <= 1)""")
def top_epochs(t):
    """The two best epochs of a run, and a third within one of the second."""
    e = t.lineitem.groupBy(F.col("l_suppkey").alias("run"), F.col("l_linenumber").alias("epoch")).agg(F.count("*").alias("parsed"), F.sum(F.col("l_orderkey") % 3).alias("failures"))
    w = Window.partitionBy("run").orderBy(F.desc("parsed"), "failures", "epoch")
    r = e.withColumn("rank", F.row_number().over(w)).withColumn("second", F.max(F.when(F.col("rank") == 2, F.col("parsed"))).over(Window.partitionBy("run")))
    return r.where((F.col("rank") <= 2) | ((F.col("rank") == 3) & (F.col("second") - F.col("parsed") <= 1))).drop("second")


@query("SELECT doc_id, CASE WHEN regexp_matches(lower(text), '(in conclusion|to conclude|overall)') THEN 'conclusion' WHEN regexp_matches(lower(text), '(this essay|this article|this paper|introduces)') THEN 'introduction' WHEN regexp_matches(lower(text), '(method|procedure|participants)') THEN 'method' WHEN regexp_matches(lower(text), '(results|findings|table)') THEN 'result' ELSE 'general' END AS kind FROM documents")
def segment_types(t):
    """Kind of a segment by the first rule that holds."""
    from lectern.operators.gates import first_reason

    c = F.lower("text")
    rules = {"conclusion": "(in conclusion|to conclude|overall)", "introduction": "(this essay|this article|this paper|introduces)", "method": "(method|procedure|participants)", "result": "(results|findings|table)"}
    return t.documents.select("doc_id", F.coalesce(first_reason({k: c.rlike(p) for k, p in rules.items()}), F.lit("general")).alias("kind"))


@query("SELECT o_orderkey, greatest(o_custkey, o_orderkey % 1000) AS attempts, coalesce(nullif(trim(CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE o_orderpriority END), ''), o_orderstatus) AS filled FROM orders")
def merged_counters(t):
    """The greater of two counters, and the first value that isn't blank."""
    first = F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(F.col("o_orderpriority"))
    return t.orders.select("o_orderkey", F.greatest("o_custkey", F.col("o_orderkey") % 1000).alias("attempts"), F.coalesce(F.nullif(F.trim(first), F.lit("")), F.col("o_orderstatus")).alias("filled"))
