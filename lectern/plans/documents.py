"""Queries that cut documents into sentences and reading segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import paragraphs as P
from lectern.functions.sentences import sentence_units, split_at_marks
from lectern.operators import cuts as C
from lectern.operators import excerpts as E
from lectern.operators.segments import segment_documents as summarised_segments
from lectern.operators.sequences import spread
from lectern.plans.registry import query

_NO_END = "|".join(x[:-1].replace(".", r"\.") for x in P.NO_END)


def _segments_sql(text: str) -> str:
    """CTEs of the sentences (c: idx from 0, p running words) and the segments (z) of an expression over documents."""
    return rf"""RECURSIVE n AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(translate(replace(coalesce({text}, ''), chr(13) || chr(10), chr(10)), '{P.COPIED.replace("'", "''")}', '{P.PLAIN.replace("'", "''")}'), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '(?m)^((?:{P.MARKDOWN_TITLE})|(?:{P.REFERENCE_TITLE}))$', chr(10) || '\1' || chr(10), 'g') AS t FROM documents),
a AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(t, '\n\n+') AS l FROM n)),
g AS (SELECT doc_id, i, trim(replace(x, chr(10), ' ')) AS g FROM a WHERE trim(replace(x, chr(10), ' ')) <> ''),
h AS (SELECT *, regexp_full_match(g, '{P.REFERENCE_TITLE}') AS title, length(regexp_extract(g, '^(#{{1,6}}) [^\s]', 1)) AS level FROM g),
f AS (SELECT *, bool_or(title) OVER (PARTITION BY doc_id ORDER BY i) AS inside, level > 0 OR title AS heading FROM h),
u AS (SELECT *, unnest(k) AS s, generate_subscripts(k, 1) AS j FROM (SELECT *, CASE WHEN heading THEN [g] ELSE string_split(replace(regexp_replace(regexp_replace(g, '(?i)({_NO_END})\.', '\1' || chr(1), 'g'), '([.!?])\s+([A-Z0-9"''(\[])', '\1' || chr(2) || '\2', 'g'), chr(1), '.'), chr(2)) END AS k FROM f)),
v AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS id, trim(s) AS s, len(regexp_extract_all(s, '{P.WORD.replace("'", "''")}')) AS words, level, heading, inside OR NOT heading AND regexp_matches(s, '{P.REFERENCE_LINE}') AS reference FROM u WHERE trim(s) <> ''),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, CASE WHEN words >= 10 THEN lower(regexp_replace(s, '\s+', ' ', 'g')) ELSE CAST(id AS VARCHAR) END ORDER BY id) AS again FROM v WHERE NOT reference),
c AS (SELECT *, row_number() OVER w - 1 AS idx, CAST(sum(words) OVER w AS BIGINT) AS p, count(*) OVER q AS n, CAST(sum(words) OVER q AS BIGINT) AS total,
  heading AND (level IN (1, 2) OR lower(regexp_extract(s, '{C._TITLE}', 1)) IN {C.MAJOR_TITLES}) AS major FROM o WHERE again = 1 OR words < 10 WINDOW w AS (PARTITION BY doc_id ORDER BY id), q AS (PARTITION BY doc_id)),
k AS (SELECT doc_id, n, idx // {C.BLOCK} AS block, unnest(regexp_extract_all(lower(s), '[a-z][a-z''-]*')) AS term FROM c WHERE total > {C.MOST}),
tf AS (SELECT doc_id, block, term, count(*) AS tf, (n + {C.BLOCK - 1}) // {C.BLOCK} AS blocks FROM k GROUP BY ALL),
x AS (SELECT doc_id, block, term, tf * (ln((1 + blocks) / CAST(1 + count(*) OVER (PARTITION BY doc_id, term) AS DOUBLE)) + 1) AS x FROM tf),
l AS (SELECT doc_id, block, sqrt(sum(x * x)) AS l FROM x GROUP BY ALL), e AS (SELECT a.doc_id, a.block, sum(a.x * b.x) AS d FROM x a JOIN x b ON a.doc_id = b.doc_id AND b.block = a.block + 1 AND a.term = b.term GROUP BY ALL),
b AS (SELECT c.doc_id, c.idx AS i, c.p AS words, nx.heading AND NOT regexp_full_match(nx.s, '{P.REFERENCE_TITLE}') AS hard,
    CASE WHEN hard THEN CASE WHEN nx.level IN (1, 2) THEN {C.MAJOR} ELSE {C.MINOR} END WHEN (c.idx + 1) % {C.BLOCK} = 0 THEN round(1 - round(coalesce(e.d / (l.l * m.l), 0), 6), 6) END AS strength
  FROM c JOIN c nx ON nx.doc_id = c.doc_id AND nx.idx = c.idx + 1 LEFT JOIN e ON e.doc_id = c.doc_id AND e.block = c.idx // {C.BLOCK} LEFT JOIN l ON l.doc_id = c.doc_id AND l.block = c.idx // {C.BLOCK} LEFT JOIN l m ON m.doc_id = c.doc_id AND m.block = c.idx // {C.BLOCK} + 1
  WHERE c.total > {C.MOST}),
st AS (SELECT doc_id, idx AS beg, p - words AS base, words > {C.MOST} AS big, n, total FROM c WHERE total > {C.MOST}),
cd AS (SELECT st.*, b.i, b.strength, abs(b.words - base - {C.TARGET}) AS dist, CASE WHEN b.words - base >= {C.LEAST} THEN 1 WHEN hard AND b.words - base >= {C.EARLY} THEN 2 END AS tier FROM st JOIN b ON b.doc_id = st.doc_id AND b.i >= st.beg AND (big OR b.words <= base + {C.MOST}) AND b.strength IS NOT NULL),
bk AS (SELECT *, max(strength) OVER (PARTITION BY doc_id, beg) - strength AS behind FROM (SELECT *, min(tier) OVER (PARTITION BY doc_id, beg) AS low FROM cd) WHERE tier = low),
bt AS (SELECT doc_id, beg, i FROM bk QUALIFY row_number() OVER (PARTITION BY doc_id, beg ORDER BY CASE WHEN behind <= 0.05 THEN 0 ELSE behind END, dist, -strength, i) = 1),
ta AS (SELECT st.doc_id, st.beg, c.idx AS i FROM st JOIN c ON c.doc_id = st.doc_id AND c.idx >= st.beg QUALIFY row_number() OVER (PARTITION BY st.doc_id, st.beg ORDER BY abs(c.p - base - {C.TARGET}), c.idx) = 1),
en AS (SELECT st.doc_id, st.beg, CASE WHEN total - base < {C.LEAST} THEN n - 1 ELSE coalesce(bt.i, ta.i) END AS e FROM st JOIN ta ON ta.doc_id = st.doc_id AND ta.beg = st.beg LEFT JOIN bt ON bt.doc_id = st.doc_id AND bt.beg = st.beg),
r(doc_id, beg, e) AS (SELECT * FROM en WHERE beg = 0 UNION ALL SELECT en.doc_id, en.beg, en.e FROM r JOIN en ON en.doc_id = r.doc_id AND en.beg = r.e + 1),
sp AS (SELECT doc_id, beg AS first, e AS last FROM r UNION ALL SELECT doc_id, 0, n - 1 FROM c WHERE total <= {C.MOST} AND idx = 0),
ar AS (SELECT doc_id, any_value(total) AS total, list(p ORDER BY idx) AS p, list(major ORDER BY idx) AS major FROM c GROUP BY doc_id),
hd AS (SELECT sp.*, p, total, major, list_filter(range(first, last + 1), lambda i: major[i + 1]) AS hs, p[last + 1] - CASE WHEN first > 0 THEN p[first] ELSE 0 END AS own FROM sp JOIN ar ON ar.doc_id = sp.doc_id),
sc AS (SELECT *, CASE WHEN len(hs) >= 3 OR len(hs) = 2 AND own >= {C.LEAST} THEN list_reduce(list_prepend([first], list_transform(hs[2:], lambda h: [h])), lambda acc, y: CASE WHEN y[1] - acc[-1] > 1 AND (len(hs) >= 3 OR p[y[1]] - CASE WHEN acc[-1] > 0 THEN p[acc[-1]] ELSE 0 END >= {C.SIDE} AND p[last + 1] - p[y[1]] >= {C.SIDE}) THEN acc || y ELSE acc END) ELSE [first] END AS s0 FROM hd),
pc AS (SELECT doc_id, total, p, major, len(s0) > 1 AS split, unnest(s0) AS first, unnest(list_transform(s0, lambda a, i: CASE WHEN i < len(s0) THEN s0[i + 1] - 1 ELSE last END)) AS last FROM sc),
lp AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first DESC) AS back, lag(last) OVER v AS after_last, lead(first) OVER v AS before_first, p[last + 1] - CASE WHEN first > 0 THEN p[first] ELSE 0 END AS own FROM pc WINDOW v AS (PARTITION BY doc_id ORDER BY first DESC)),
mg AS (SELECT *, back = 1 AND total > {C.MOST} AND before_first IS NOT NULL AND own < {C.LEAST} AND NOT major[first + 1] AND p[last + 1] - CASE WHEN before_first > 0 THEN p[before_first] ELSE 0 END <= {1.25 * C.MOST} AS gone FROM lp),
z AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS segment_id, first, CASE WHEN joined THEN after_last ELSE last END AS last, split AND NOT joined AS split FROM (SELECT *, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY first DESC), false) AS joined FROM mg) WHERE NOT gone)"""


_CUTS = """SELECT z.doc_id, CAST(z.segment_id AS INTEGER) AS segment_id, CAST(min(c.id) AS INTEGER) AS first_sentence, CAST(max(c.id) AS INTEGER) AS last_sentence, CAST(sum(c.words) AS INTEGER) AS word_count,
  CASE WHEN any_value(z.split) THEN 'major_heading_boundary' ELSE 'semantic_or_size_boundary' END AS split_reason, md5(string_agg(c.s, ' ' ORDER BY c.id)) AS content FROM z JOIN c ON c.doc_id = z.doc_id AND c.idx BETWEEN z.first AND z.last GROUP BY z.doc_id, z.segment_id"""

# some lines made headings: the tables' texts have few
_HEADED = "array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i % 9 = 1 AND x <> '' THEN '## ' || x WHEN i % 23 = 11 THEN '### ' || x ELSE x END), chr(10))"


def headed(t):
    line = F.transform(F.split("text", "\n"), lambda x, i: F.when((i % 9 == 0) & (x != ""), F.concat(F.lit("## "), x)).when(i % 23 == 10, F.concat(F.lit("### "), x)).otherwise(x))
    return t.documents.select("doc_id", F.array_join(line, "\n").alias("text"))


@query(f"WITH {_segments_sql('text')} {_CUTS}")
def segment_cuts(t):
    """Reading segments of the documents: sentences, word counts and content."""
    return C.segments(t.documents).withColumn("content", F.md5("content"))


@query(f"WITH {_segments_sql(_HEADED)} {_CUTS}")
def segment_cuts_headed(t):
    """Reading segments of the documents with some lines as headings."""
    return C.segments(headed(t)).withColumn("content", F.md5("content"))


_LENGTHS = ", ".join(f"('{k}', {a}, {b}, {c})" for k, (a, b, c) in E.LENGTHS.items())


def _marks_sql(text: str) -> str:
    t = f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"
    for a in ("e.g.", "i.e.", "U.S.", "U.K."):
        t = f"replace({t}, '{a}', '{a.replace('.', chr(0x2024))}')"
    cut = f"string_split(regexp_replace({t}, '([.!?])\\s+([A-Z0-9\"''(\\[])', '\\1' || chr(2) || '\\2', 'g'), chr(2))"
    return f"list_filter(list_transform({cut}, lambda x: trim(replace(x, '{chr(0x2024)}', '.'))), lambda x: x <> '')"


@query(f"""WITH {_segments_sql("text").split(",\nh AS")[0]},
w AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS i, CAST(sum(len(regexp_extract_all(g, '{P.WORD.replace("'", "''")}'))) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS upto FROM g),
s AS (SELECT w.doc_id, w.i AS start, coalesce(b.upto, 0) AS base, l.* FROM w LEFT JOIN w b ON b.doc_id = w.doc_id AND b.i = w.i - 1 CROSS JOIN (VALUES {_LENGTHS}) l(bucket, least, most, target) WHERE w.i < {E.STARTS}),
f AS (SELECT s.*, w.i, w.upto - base AS words FROM s JOIN w ON w.doc_id = s.doc_id AND w.i >= s.start AND w.upto - base <= most),
nf AS (SELECT s.doc_id, s.bucket, s.start, s.least, s.most, s.target, count(f.i) AS n, coalesce(max(f.words), 0) AS taken FROM s LEFT JOIN f ON f.doc_id = s.doc_id AND f.bucket = s.bucket AND f.start = s.start GROUP BY ALL),
m AS (SELECT nf.*, unnest({_marks_sql("w.g")}) AS t, generate_subscripts({_marks_sql("w.g")}, 1) AS k FROM nf JOIN w ON w.doc_id = nf.doc_id AND w.i = nf.start + nf.n),
c AS (SELECT doc_id, bucket, start, least, target, words, i - start + 1 AS pieces, i - start + 1 AS whole, 0 AS sentences FROM f UNION ALL
  SELECT doc_id, bucket, start, least, target, words, n + k, n, k FROM (SELECT *, taken + CAST(sum(len(regexp_extract_all(t, '{P.WORD.replace("'", "''")}'))) OVER (PARTITION BY doc_id, bucket, start ORDER BY k) AS BIGINT) AS words FROM m) WHERE words <= most),
b AS (SELECT * FROM c WHERE words >= least QUALIFY row_number() OVER (PARTITION BY doc_id, bucket ORDER BY abs(words - target), start, pieces, words, whole) = 1)
SELECT b.doc_id, b.bucket, CAST(b.start AS INTEGER) AS start, words, CAST(pieces AS INTEGER) AS pieces, md5(array_to_string(list_concat((SELECT list(g ORDER BY i) FROM w WHERE w.doc_id = b.doc_id AND i >= b.start AND i < b.start + whole), list_slice({_marks_sql("x.g")}, 1, sentences)), chr(10) || chr(10))) AS excerpt
FROM b LEFT JOIN w x ON x.doc_id = b.doc_id AND x.i = b.start + whole""")
def length_excerpts(t):
    """Excerpts of each length that a document can give: where they begin, words, pieces and digest."""
    return E.excerpts(spread(t.documents)).withColumn("excerpt", F.md5("excerpt"))


@query()
def segment_documents(t):
    """Reading segments of each document, with their summaries."""
    return summarised_segments(t.documents)


@query()
def sentence_splitters(t):
    """Sentences by the native split and by the scanner, whose differences an audit looks at."""
    d = t.documents.select("doc_id", split_at_marks(F.col("text")).alias("native"), sentence_units("text").alias("scanned"))
    return d.select("doc_id", F.size("native").alias("native"), F.size("scanned").alias("scanned"), (F.size("native") != F.size("scanned")).alias("differs"))
