"""The registered queries of this package, their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm.licenses import oracle_sql as license_sql


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lectern.llm.bpe import encode_documents

    docs = read(spark, sf_dir, "documents")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id"], ids=False, digests=True)


def op2_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.lattice import near_duplicate_vectors

    return near_duplicate_vectors(read(spark, sf_dir, "embeddings"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.minhash import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"), k=3, percent=85, bands=20)


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.passages import repeated_passages

    return repeated_passages(read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.toxicity import score_toxicity

    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.topk import top_inner_products

    return top_inner_products(read(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

def op3_pfair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.mixing import mix, target_weights

    docs = read(spark, sf_dir, "documents")
    return mix(docs, target_weights(docs))


OP3_SQL = """
WITH RECURSIVE c AS (SELECT source, count(*) AS n, sqrt(CAST(count(*) AS DOUBLE)) AS weight FROM documents GROUP BY source),
k AS (SELECT source, CAST(greatest(1, round(weight / max(weight) OVER () * 1073741824)) AS BIGINT) AS w, CAST((n + 15) // 16 AS BIGINT) AS blocks FROM c),
one AS (SELECT list({'source': source, 'w': w, 'blocks': blocks} ORDER BY source NULLS FIRST) AS s, CAST(sum(w) AS BIGINT) AS total FROM k),
ends AS (SELECT list_reverse_sort(list_transform(s, lambda x: (x.blocks * total + x.w - 1) // x.w)) AS e FROM one),
sim(slot, run, pick) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(s, lambda x: CAST(0 AS BIGINT)), CAST(NULL AS BIGINT) FROM one
  UNION ALL
  SELECT slot + 1, list_transform(run, lambda r, i: CASE WHEN i - 1 = p THEN r + 1 ELSE r END), p
  FROM (SELECT slot, run, list_min(list_filter(list_transform(s, lambda x, i: CASE WHEN (run[i] * total) // x.w <= slot + 1
      THEN {'late': ((run[i] + 1) * total + x.w - 1) // x.w, 'i': CAST(i - 1 AS BIGINT)} END), lambda y: y IS NOT NULL)).i AS p
    FROM sim, one, ends WHERE slot + 1 < coalesce(e[2], e[1]))),
plan AS (SELECT s[pick + 1].source AS source, slot, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS j FROM sim, one WHERE pick IS NOT NULL),
d AS (SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1) AS number FROM documents)
SELECT d.doc_id, d.source, number // 16 AS block, coalesce(slot, ((number // 16 + 1) * total + w - 1) // w - 1) AS slot, CAST(number % 16 AS INTEGER) AS place
FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source CROSS JOIN one LEFT JOIN plan ON d.source IS NOT DISTINCT FROM plan.source AND number // 16 = j
"""


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.quality import quality_scores

    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.licenses import scan_licenses

    return scan_licenses(read(spark, sf_dir, "documents"))


def captures(pages: DataFrame) -> DataFrame:
    """Crawl records made from pages: at 10 * page_id the full response of all pages but every seventh, of
    every fifth without an etag; and for two of three pages a revisit 10,005 later, whose etag is the
    page's for one and another for the other; every eleventh carries none."""
    from pyspark.sql import functions as F

    i = F.col("page_id")
    p = pages.select("page_id", "url", F.md5("html").alias("md5"), F.length("html").alias("n"))
    etag, none = F.concat(F.lit('"'), F.col("md5"), F.lit('"')), F.lit(None).cast("string")
    full = p.where("page_id % 7 <> 0").select(
        (2 * i).alias("id"), "url", (10 * i).alias("ts"), F.lit("response").alias("kind"), F.when(i % 5 != 0, etag).alias("etag"), none.alias("last_modified"), F.col("md5").alias("digest"),
        F.create_map(F.lit("content-length"), F.col("n").cast("string"), F.lit("date"), (10 * i).cast("string"), F.lit("etag"), etag).alias("headers"),
    )
    other = F.when(i % 11 == 0, none).when(i % 3 == 1, F.concat(F.lit("W/"), etag)).otherwise(F.lit('"gone"'))
    again = p.where("page_id % 3 <> 0").select(
        (2 * i + 1).alias("id"), "url", (10 * i + 10_005).alias("ts"), F.lit("revisit").alias("kind"), other.alias("etag"), none.alias("last_modified"), none.alias("digest"),
        F.create_map(F.lit("content-length"), F.lit("0"), F.lit("date"), (10 * i + 10_005).cast("string")).alias("headers"),
    )
    return full.unionAll(again)


def op8_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from lectern.llm.warc import resolve_revisits

    out = resolve_revisits(captures(read(spark, sf_dir, "pages")))
    header = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")
    return out.withColumn("headers", header)


OP8_SQL = r"""
WITH p AS (SELECT page_id, url, md5(html) AS md5, length(html) AS n FROM pages),
c AS (SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM p),
k AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^[^@]*@', ''), ':(80|443)$', ''), '^www\.', '')
    || regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') AS base,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'),
    lambda q: q <> '' AND NOT list_contains(['fbclid', 'gclid', 'ref', 'utm_campaign', 'utm_content', 'utm_medium', 'utm_source', 'utm_term'], regexp_extract(q, '^([^=]*)', 1)))), '&') AS params FROM c),
r AS (SELECT page_id, base || CASE WHEN params <> '' THEN '?' || params ELSE '' END AS url, md5, n FROM k),
v AS (SELECT 2 * page_id + 1 AS id, url, 10 * page_id + 10005 AS ts, CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 3 = 1 THEN '"' || md5 || '"' ELSE '"gone"' END AS etag FROM r WHERE page_id % 3 <> 0),
j AS (SELECT v.*, 2 * r.page_id AS response_id, 10 * r.page_id AS response_ts, r.md5, r.n, CASE WHEN r.page_id % 5 <> 0 THEN '"' || r.md5 || '"' END AS stored FROM v LEFT JOIN r ON r.url = v.url AND 10 * r.page_id < v.ts AND r.page_id % 7 <> 0
  QUALIFY row_number() OVER (PARTITION BY v.id ORDER BY r.page_id DESC NULLS LAST) = 1),
o AS (SELECT *, CASE WHEN response_id IS NULL THEN 'missing' WHEN etag IS NULL OR stored IS NULL THEN 'unchecked' WHEN stored = etag THEN 'resolved' ELSE 'mismatch' END AS outcome FROM j)
SELECT id, url, ts, response_id, response_ts, CASE WHEN outcome IN ('resolved', 'unchecked') THEN md5 END AS digest,
  CASE WHEN outcome IN ('resolved', 'unchecked') THEN 'content-length: ' || n || '; date: ' || ts || '; etag: "' || md5 || '"' END AS headers, outcome FROM o
"""

OP2_SQL = """
WITH RECURSIVE a AS (SELECT DISTINCT vec_id, label, embedding FROM embeddings WHERE vec_id IS NOT NULL),
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM a
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_dot_product(x.e, y.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))) >= 0.93),
r(id, other) AS (SELECT a, b FROM l UNION SELECT r.id, l.b FROM r JOIN l ON r.other = l.a),
c AS (SELECT id, least(id, min(other)) AS component FROM r GROUP BY id), n AS (SELECT a AS id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, vec_id = coalesce(component, vec_id) AS kept
FROM (SELECT DISTINCT vec_id FROM a) LEFT JOIN n ON n.id = vec_id LEFT JOIN c ON c.id = vec_id
"""

OP4_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r(id, other) AS (SELECT a, b FROM l UNION SELECT r.id, l.b FROM r JOIN l ON r.other = l.a),
c AS (SELECT id, least(id, min(other)) AS component FROM r GROUP BY id)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, w.doc_id) AS component_id, w.doc_id = coalesce(component, w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.id = w.doc_id
"""

#: Table t of CRC-32 by its rule, and the unsigned CRC-32 of the UTF-8 bytes of an expression.
CRC_TABLE = "t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(CAST(n AS BIGINT), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"


def crc32_sql(text: str) -> str:
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST(('0x' || x) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.spelling import spelling_variants, word_counts

    return spelling_variants(word_counts(read(spark, sf_dir, "documents")))


OP13_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
d AS (SELECT w, count(*) AS k, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w AS s FROM r GROUP BY doc_id, w),
h AS (SELECT w, k, {crc32_sql("s")} AS h FROM d, t),
e AS (SELECT k, CASE WHEN h % 31 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM h),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n, length(word) AS len FROM e WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cut AS (SELECT word, len, i, left(word, i) AS l, substr(word, i + 2) AS r FROM (SELECT word, len, unnest(range(len)) AS i FROM v)),
one AS (SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.len = b.len AND a.i = b.i AND a.l = b.l AND a.r = b.r AND a.word <> b.word),
gap AS (SELECT DISTINCT v.word AS a, cut.word AS b FROM v JOIN cut ON cut.l || cut.r = v.word),
near AS (SELECT a, b FROM one UNION ALL SELECT a, b FROM gap UNION ALL SELECT b, a FROM gap),
f AS (SELECT a AS word, b, v.n AS m, count(*) OVER (PARTITION BY a) AS n_near FROM near JOIN v ON v.word = b QUALIFY row_number() OVER (PARTITION BY a ORDER BY v.n DESC, b) = 1),
j AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * v.n THEN b END AS form, CASE WHEN m >= 10 * v.n THEN m END AS form_n FROM v LEFT JOIN f ON f.word = v.word),
c(word, stop) AS (SELECT word, word FROM j UNION ALL SELECT c.word, j.form FROM c JOIN j ON j.word = c.stop WHERE j.form IS NOT NULL)
SELECT j.word, j.form, c.stop AS root, j.n, j.n_near, j.form_n FROM j JOIN c ON c.word = j.word JOIN j last ON last.word = c.stop AND last.form IS NULL
"""

def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.trie import prefix_trie, with_shared_heads

    return prefix_trie(*with_shared_heads(read(spark, sf_dir, "conversations"))).drop("role", "text")


OP11_SQL = rf"""
WITH {CRC_TABLE},
n AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT conv_id, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h, conv_id - conv_id % 20 AS base FROM (SELECT DISTINCT conv_id FROM n), t),
r AS (SELECT i.conv_id, pos, role, text FROM i JOIN n ON n.conv_id = i.conv_id AND pos > h UNION ALL SELECT i.conv_id, pos, role, text FROM i JOIN n ON n.conv_id = base AND pos <= h),
s AS (SELECT conv_id, list(md5(role) || md5(text) ORDER BY pos) AS s, list(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) ORDER BY pos) AS k FROM r GROUP BY conv_id),
a AS (SELECT i.conv_id, coalesce(s, []) AS s, coalesce(k, []) AS k FROM i LEFT JOIN s ON s.conv_id = i.conv_id),
p AS (SELECT conv_id, d, array_to_string(list_slice(s, 1, d), '') AS key, CASE WHEN d > 0 THEN k[d] ELSE 0 END AS words, len(s) = d AS last FROM (SELECT *, unnest(range(len(s) + 1)) AS d FROM a)),
v AS (SELECT d, key, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) * (count(*) - 1) AS saved, array_to_string(list(conv_id ORDER BY conv_id) FILTER (last), ',') AS ends FROM p GROUP BY d, key),
c AS (SELECT v.d, v.key, count(*) AS n_children FROM v JOIN v b ON b.d = v.d + 1 AND starts_with(b.key, v.key) GROUP BY ALL),
w AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN c ON c.d = v.d AND c.key = v.key)
SELECT w.conv_id, w.d AS depth, any_value(up.conv_id) AS parent_conv_id, w.n_convs, w.n_children, count(*) FILTER (b.n_children = 0) AS n_leaves, CAST(sum(b.saved) AS BIGINT) AS saved_tokens, sha256(coalesce(w.ends, '')) AS ends_sha256
FROM w JOIN w b ON b.d >= w.d AND starts_with(b.key, w.key) LEFT JOIN w up ON up.d = w.d - 1 AND starts_with(w.key, up.key) GROUP BY w.conv_id, w.d, w.n_convs, w.n_children, w.ends
"""

def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from lectern.llm.sharding import OVERHEAD, shuffle_shards

    out = shuffle_shards(read(spark, sf_dir, "documents").select("doc_id", "text"), shards=40)
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long")
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0))
    return out.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), F.col("__shard").alias("shard"), F.col("__slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _draw_sql(text: str) -> str:
    return f"CAST(('0x' || substr(md5({text}), 1, 15)) AS BIGINT)"


OP12_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, {crc32_sql("coalesce(text, '')")} AS crc FROM documents, t),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, size, crc) - 1 AS copy FROM d),
total AS (SELECT count(*) AS rows, greatest(1, (sum(size) + 16777215) // 16777216, (count(*) + 999) // 1000) AS buckets FROM d),
h AS (SELECT n.*, {_draw_sql("'7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size || ':' || crc || ':' || copy")} AS h FROM n),
b AS (SELECT h % buckets AS bucket, list({{'h': h, 'doc_id': doc_id, 'size': size, 'crc': crc}} ORDER BY h, doc_id NULLS FIRST, size, crc, copy) AS a FROM h, total GROUP BY bucket),
f(bucket, i, a) AS (SELECT bucket, CAST(len(a) - 1 AS BIGINT), a FROM b UNION ALL
  SELECT bucket, i - 1, list_transform(a, lambda x, k: CASE WHEN k = i + 1 THEN a[j + 1] WHEN k = j + 1 THEN a[i + 1] ELSE x END)
  FROM (SELECT *, {_draw_sql("'7:swap:' || bucket || ':' || i")} % (i + 1) AS j FROM f WHERE i >= 0)),
o AS (SELECT a, coalesce(sum(len(a)) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f WHERE i = -1),
p AS (SELECT a[k].doc_id AS doc_id, a[k].size AS size, a[k].crc AS crc, CAST(before + k - 1 AS BIGINT) AS place FROM (SELECT a, before, unnest(range(1, len(a) + 1)) AS k FROM o))
SELECT doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'rows' AS law, CAST(place * 40 // rows AS INTEGER) AS shard,
  CAST(place - (place * 40 // rows * rows + 39) // 40 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p, total
"""

QUERIES = {"op8_revisits": op8_revisits, "op1_licenses": op1_licenses, "op5_quality": op5_quality, "op3_pfair": op3_pfair, "op7_topk": op7_topk, "op10_toxicity": op10_toxicity, "op9_passages": op9_passages, "op2_lattice": op2_lattice, "op4_minhash": op4_minhash, "op6_bpe": op6_bpe, "op11_trie": op11_trie, "op12_shards": op12_shards, "op13_variants": op13_variants}
ORACLE_SQL: dict[str, str] = {"op2_lattice": OP2_SQL, "op4_minhash": OP4_SQL, "op8_revisits": OP8_SQL, "op1_licenses": license_sql(), "op3_pfair": OP3_SQL, "op7_topk": OP7_SQL, "op11_trie": OP11_SQL, "op12_shards": OP12_SQL, "op13_variants": OP13_SQL}
