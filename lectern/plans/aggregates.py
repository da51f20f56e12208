"""Queries that group: profiles, histograms, cross-tabs, rates, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as X
from lectern.operators import metrics as M
from lectern.operators.cuts import computed
from lectern.operators.sequences import spread
from lectern.plans.registry import query

_WORDS = "CAST(len(regexp_extract_all(text, '[A-Za-z0-9]+(?:[''-][A-Za-z0-9]+)*')) AS BIGINT)"
_BUCKET = "CASE WHEN words <= 400 THEN 'short' WHEN words <= 800 THEN 'medium' ELSE 'long' END"
_SIZED = f"WITH d AS (SELECT *, {_BUCKET} AS bucket FROM (SELECT doc_id, lang, source, text, {_WORDS} AS words FROM documents))"


def sized(docs):
    """Documents with their ASCII words and natural bucket, without text."""
    d = computed(spread(docs.select("doc_id", "lang", "source", "text")), words=X.word_count(F.col("text")).cast("long")).drop("text")
    return d.withColumn("bucket", X.natural_bucket(F.col("words")))


@query(_SIZED + """ SELECT lang, bucket, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS percent,
 round(quantile_cont(words, 0.5), 6) AS p50, round(quantile_cont(words, 0.95), 6) AS p95 FROM d GROUP BY lang, bucket""")
def length_profile(t):
    """Documents by language and length bucket, with shares and exact percentiles of words."""
    g = sized(t.documents).groupBy("lang", "bucket").agg(F.count("*").alias("n"), F.round(F.percentile("words", 0.5), 6).alias("p50"), F.round(F.percentile("words", 0.95), 6).alias("p95"))
    return g.withColumn("percent", F.round(M.share("n", "lang"), 6))


@query(_SIZED + """, b AS (SELECT * FROM (VALUES ('<=300', 0, 300), ('301-400', 301, 400), ('401-500', 401, 500), ('501-600', 501, 600), ('601-700', 601, 700), ('701-800', 701, 800), ('801-900', 801, 900), ('901-1000', 901, 1000), ('1001-1100', 1001, 1100), ('1101-1200', 1101, 1200), ('>1200', 1201, 9223372036854775807)) AS v(bin, lo, hi)),
g AS (SELECT bin, count(doc_id) AS n FROM b LEFT JOIN d ON words BETWEEN lo AND hi GROUP BY bin) SELECT bin, n, round(100.0 * n / sum(n) OVER (), 6) AS percent FROM g""")
def length_histogram(t):
    """Eleven fixed bins of words, empty ones too."""
    return M.histogram(sized(t.documents), "words", M.LENGTH_BINS)


@query(_SIZED + " SELECT lang, count(*) FILTER (WHERE bucket = 'short') AS short, count(*) FILTER (WHERE bucket = 'medium') AS medium, count(*) FILTER (WHERE bucket = 'long') AS long, count(*) AS total FROM d GROUP BY lang")
def lang_bucket_crosstab(t):
    """Language against bucket, with row totals."""
    return M.cross_tab(sized(t.documents), "lang", "bucket", ["short", "medium", "long"])


@query(_SIZED + " SELECT lang, bucket, count(*) AS n, CAST(sum(words) AS BIGINT) AS words, CAST(grouping(lang) * 2 + grouping(bucket) AS INTEGER) AS level FROM d GROUP BY GROUPING SETS ((lang), (bucket), (lang, bucket), ())")
def breakdown_grouping_sets(t):
    """Counts by language, by bucket, by both and in all, in one pass."""
    d = sized(t.documents)
    g = d.groupingSets([["lang"], ["bucket"], ["lang", "bucket"], []], "lang", "bucket")
    return g.agg(F.count("*").alias("n"), F.sum("words").alias("words"), F.grouping_id().cast("int").alias("level"))


_Q = ", ".join(f"round(quantile_cont(words, {q / 100}), 4) AS p{q}" for q in (10, 25, 33, 50, 67, 75, 90, 95, 99))


@query(_SIZED + f" SELECT source, min(words) AS min, max(words) AS max, round(avg(words), 4) AS mean, count(*) AS n, {_Q} FROM d GROUP BY source")
def length_stats_by_source(t):
    """Twelve exact statistics of words by source."""
    return M.length_stats(sized(t.documents), ["source"], "words")


@query(_SIZED + " SELECT lang, min(words) AS min, round(quantile_cont(words, 0.05), 4) AS p05, round(median(words), 4) AS median, round(avg(words), 4) AS mean, round(quantile_cont(words, 0.95), 4) AS p95, max(words) AS max FROM d GROUP BY lang")
def audit_stats(t):
    """Six audit statistics of words by language."""
    return M.audit_stats(sized(t.documents), ["lang"], "words")


@query("SELECT lang, CAST(quantile_disc(n_chars, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(n_chars, 0.95) AS BIGINT) AS p95, min(n_chars) AS min, max(n_chars) AS max FROM documents GROUP BY lang")
def nearest_rank(t):
    """Nearest-rank percentiles of characters: values that occur."""
    return M.nearest_rank(t.documents, ["lang"], "n_chars", {"p50": 0.5, "p95": 0.95})


@query("SELECT label, count(*) AS n, round(avg(embedding[1]), 9) AS mean, round(median(CAST(embedding[1] AS DOUBLE)), 9) AS median, round(stddev_pop(embedding[1]), 9) AS stddev, round(min(embedding[1]), 9) AS min, round(max(embedding[1]), 9) AS max FROM (SELECT label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS embedding FROM embeddings) GROUP BY label")
def score_stats(t):
    """Score statistics with the population's standard deviation."""
    return M.score_stats(t.embeddings.select("label", F.col("embedding")[0].cast("double").alias("score")), ["label"], "score")


@query("SELECT d.lang, count(*) AS judged, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic, round(100.0 * count(*) FILTER (WHERE quality = 1) / count(*), 6) AS good_rate, round(100.0 * count(*) FILTER (WHERE toxic = 1) / count(*), 6) AS toxic_rate FROM documents d JOIN labels USING (doc_id) GROUP BY d.lang")
def flag_rates(t):
    """Counts and rates of boolean flags."""
    j = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id")
    return M.flag_rates(j.withColumns({"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}), ["lang"], ["good", "toxic"], "judged")


@query("""WITH s AS (SELECT source, count(*) AS prepared FROM documents GROUP BY source), j AS (SELECT source, count(*) AS judged, sum(quality) AS good, count(*) FILTER (WHERE toxic = 1) AS severe FROM documents JOIN labels USING (doc_id) GROUP BY source)
SELECT source, prepared, coalesce(judged, 0) AS judged, coalesce(severe, 0) AS severe, round(100.0 * coalesce(judged, 0) / prepared, 6) AS valid_rate, round(CAST(good AS DOUBLE) / judged, 6) AS mean FROM s LEFT JOIN j USING (source)""")
def system_summary(t):
    """Judged rows of each system over prepared ones, with severe failures and the mean."""
    d = t.documents.select("doc_id", "source")
    prepared = d.groupBy("source").agg(F.count("*").alias("prepared"))
    j = d.join(t.labels, "doc_id").groupBy("source").agg(F.count("*").alias("judged"), F.avg("quality").alias("mean"), F.count_if(F.col("toxic") == 1).alias("severe"))
    out = prepared.join(j, "source", "left").fillna(0, ["judged", "severe"])
    return out.select("source", "prepared", "judged", "severe", F.round(100.0 * F.col("judged") / F.col("prepared"), 6).alias("valid_rate"), F.round("mean", 6).alias("mean"))


@query("SELECT k AS tag, count(*) AS n, count(DISTINCT event_type) AS kinds FROM (SELECT event_type, unnest(json_keys(props)) AS k FROM events) GROUP BY k")
def tag_counts(t):
    """Counts of labels in an array column."""
    return M.tag_counts(t.events.select("event_type", F.json_object_keys("props").alias("tags")), "tags").join(
        t.events.select("event_type", F.explode(F.json_object_keys("props")).alias("tag")).groupBy("tag").agg(F.countDistinct("event_type").alias("kinds")), "tag"
    )


@query("""WITH f AS (SELECT doc_id, unnest(list_filter([CASE WHEN n_chars < 100 THEN 'tiny' END, CASE WHEN regexp_matches(text, '[#$%&*]{3}') THEN 'symbols' END, CASE WHEN contains(text, 'http') THEN 'link' END, CASE WHEN contains(text, '!!') THEN 'shouting' END], lambda x: x IS NOT NULL)) AS flag FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY doc_id) AS rn FROM f) SELECT flag, count(*) AS n, array_to_string(list(doc_id ORDER BY doc_id) FILTER (WHERE rn <= 5), ',') AS examples FROM r GROUP BY flag""")
def flag_examples(t):
    """Counts of each flag with its first five documents."""
    c = F.col("text")
    flags = {"tiny": F.col("n_chars") < 100, "symbols": c.rlike("[#$%&*]{3}"), "link": F.contains(c, F.lit("http")), "shouting": F.contains(c, F.lit("!!"))}
    return M.flag_examples(t.documents, flags, "doc_id", 5)


@query("""WITH w AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[a-z][a-z''-]*')) AS term FROM documents), d AS (SELECT lang, term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM w GROUP BY ALL), n AS (SELECT lang, count(*) AS docs FROM documents GROUP BY lang)
SELECT lang, term, tf, df, round(ln((1 + docs) / CAST(1 + df AS DOUBLE)) + 1, 9) AS idf FROM d JOIN n USING (lang) WHERE df >= 10""")
def term_statistics(t):
    """Term and document frequencies and IDF of each language's terms in ten documents or more."""
    return M.term_stats(t.documents, "lang", least=10)


@query("""WITH w AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[a-z][a-z''-]*')) AS term FROM documents), c AS (SELECT lang, term, count(*) AS n FROM w WHERE length(term) > 3 GROUP BY ALL)
SELECT lang, term, n, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS INTEGER) AS rank FROM c QUALIFY rank <= 20""")
def top_terms(t):
    """The twenty most frequent longer terms of each language."""
    w = t.documents.select("lang", F.explode(X.tokens(F.col("text"))).alias("term")).where(F.length("term") > 3).groupBy("lang", "term").agg(F.count("*").alias("n"))
    return w.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "term"))).where("rank <= 20")


@query("""SELECT conv_id, count(*) AS items, count(*) FILTER (WHERE length(text) > 40) AS ok, CASE WHEN bool_and(length(text) > 40) THEN 'ok' WHEN bool_or(length(text) > 40) THEN 'partial_error' ELSE 'error' END AS status FROM conversations GROUP BY conv_id""")
def batch_status(t):
    """A batch's status from those of its items."""
    ok = F.length("text") > 40
    status = F.when(F.every(ok), "ok").when(F.some(ok), "partial_error").otherwise("error")
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("items"), F.count_if(ok).alias("ok"), status.alias("status"))


@query("""SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(max(o_totalprice), 2) AS peak FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)""")
def order_rollup(t):
    """Totals by priority and status, by priority, and in all."""
    return t.orders.rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.round(F.max("o_totalprice"), 2).alias("peak"))


@query("SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(t):
    """Grouped sums and means with a filter that reaches the scan."""
    d = t.lineitem.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return d.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("n"))


@query("SELECT user_id, max(value) AS peak, count(*) AS samples, count(value) AS present, greatest(max(value), 0.0) AS floor FROM events GROUP BY user_id")
def peak_samples(t):
    """Peak of samples that may be null."""
    return t.events.groupBy("user_id").agg(F.max("value").alias("peak"), F.count("*").alias("samples"), F.count("value").alias("present"), F.greatest(F.max("value"), F.lit(0.0)).alias("floor"))


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def daily_events(t):
    """Events and users by day and type."""
    return t.events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 6).alias("total"))
