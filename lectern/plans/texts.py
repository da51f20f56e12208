"""Queries over single texts: counts, ratios, normal forms, predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators.cuts import computed
from lectern.operators.sequences import spread
from lectern.plans.registry import query

_COUNT = "CAST(len(regexp_extract_all({}, '{}')) AS INTEGER)"


def _n(expr: str, pattern: str) -> str:
    return _COUNT.format(expr, pattern.replace("'", "''"))


@query(f"""SELECT doc_id, {_n("text", X.WORD["ascii"])} AS ascii_words, {_n("text", X.WORD["ascii_one_suffix"])} AS one_suffix_words, {_n("text", X.WORD["unicode"])} AS unicode_words,
 {_n("text", X.WORD["nonblank"])} AS nonblank_words, {_n("lower(text)", "[a-z][a-z'-]*")} AS letter_tokens FROM documents""")
def word_count_variants(t):
    """The five word definitions side by side."""
    return t.documents.select("doc_id", X.word_count(F.col("text")).alias("ascii_words"), X.word_count(F.col("text"), "ascii_one_suffix").alias("one_suffix_words"), X.word_count(F.col("text"), "unicode").alias("unicode_words"), X.word_count(F.col("text"), "nonblank").alias("nonblank_words"), F.size(X.tokens(F.col("text"))).alias("letter_tokens"))


_LETTERS, _LATIN, _DENSE = (f"len(regexp_extract_all(text, '{p}'))" for p in (r"\p{L}", "[A-Za-z]", r"\S"))


@query(f"""SELECT doc_id, CASE WHEN length(text) = 0 THEN 0.0 ELSE round(CAST({_LETTERS} AS DOUBLE) / length(text), 9) END AS alpha_ratio,
 CASE WHEN {_DENSE} = 0 THEN 0.0 ELSE round(CAST({_LETTERS} AS DOUBLE) / {_DENSE}, 9) END AS dense_alpha_ratio,
 CASE WHEN {_LETTERS} = 0 THEN 0.0 ELSE round(CAST({_LATIN} AS DOUBLE) / {_LETTERS}, 9) END AS latin_ratio FROM documents""")
def char_ratios(t):
    """Letters among characters, among non-blanks, and Latin letters among letters."""
    c = F.col("text")
    d = computed(spread(t.documents.select("doc_id", "text")), all=F.length(c), letters=X.char_count(c, r"\p{L}"), dense=X.char_count(c, r"\S"), latin=X.char_count(c, "[A-Za-z]"))
    parts = {"alpha_ratio": ("letters", "all"), "dense_alpha_ratio": ("letters", "dense"), "latin_ratio": ("latin", "letters")}
    return d.select("doc_id", *[F.round(X.ratio(F.col(a), F.col(b)), 9).alias(n) for n, (a, b) in parts.items()])


@query(rf"""SELECT doc_id, {_n("text", X.MATH_SYMBOLS)} AS math_symbols, {_n("text", "[0-9]")} AS digits, {_n("text", "[?]")} AS question_marks, {_n("text", "https?://")} AS urls,
 {_n("lower(text)", "(^|[^a-z0-9_])[a-d][.][ \t\n\r\f]")} AS option_markers, {_n("text", "[^\x01-\x7f]")} AS non_ascii FROM documents""")
def char_marks(t):
    """Counts of mathematical symbols, digits, question marks, links and answer options."""
    c = F.col("text")
    return t.documents.select("doc_id", *[F.regexp_count(c, F.lit(p)).alias(n) for n, p in (("math_symbols", X.MATH_SYMBOLS), ("digits", "[0-9]"), ("question_marks", "[?]"), ("urls", "https?://"), ("option_markers", X.OPTION_MARKER), ("non_ascii", "[^\\x01-\\x7f]"))])


_STOP = "[" + ", ".join(f"'{w}'" for w in X.ENGLISH_STOP) + "]"


@query(f"""WITH k AS (SELECT doc_id, list_slice(regexp_extract_all(lower(text), '[a-z'']+'), 1, 220) AS w FROM documents)
SELECT doc_id, CASE WHEN len(w) = 0 THEN 0.0 ELSE round(CAST(len(list_filter(w, lambda x: list_contains({_STOP}, x))) AS DOUBLE) / len(w), 9) END AS english_score FROM k""")
def english_score(t):
    """Share of English stop words among the first 220 tokens."""
    return t.documents.select("doc_id", F.round(X.english_score(F.col("text")), 9).alias("english_score"))


@query("""WITH k AS (SELECT doc_id, text, len(regexp_extract_all(text, '\\p{L}')) AS n, len(regexp_extract_all(text, '[A-Za-z]')) AS l FROM documents)
SELECT doc_id, text <> '' AND NOT regexp_matches(text, '[\\x{4e00}-\\x{9fff}\\x{fffd}]') AND n > 0 AND CAST(l AS DOUBLE) / n >= 0.97 AS clean FROM k""")
def clean_english(t):
    """Whether a text is nearly all Latin letters, without CJK or damaged characters."""
    return t.documents.select("doc_id", X.is_clean_english(F.col("text")).alias("clean"))


@query("SELECT doc_id, md5(trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g'))) AS digest FROM documents")
def collapsed_text(t):
    """Digest of the text with blanks collapsed."""
    return t.documents.select("doc_id", F.md5(X.collapse_spaces(F.col("text"))).alias("digest"))


@query("""WITH a AS (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS x FROM documents),
b AS (SELECT doc_id, regexp_replace(translate(x, chr(160) || chr(8216) || chr(8217) || chr(8220) || chr(8221) || chr(8211) || chr(8212) || chr(8722) || chr(8203) || chr(8204) || chr(8205) || chr(65279), ' ''''""---'), '[ \\t]+', ' ', 'g') AS x FROM a)
SELECT doc_id, md5(regexp_replace(regexp_replace(x, '\\n{3,}', chr(10) || chr(10), 'g'), '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g')) AS digest FROM b""")
def basic_formatting(t):
    """Digest of the text with plain quotes, dashes, spaces and line ends."""
    return t.documents.select("doc_id", F.md5(X.basic_formatting(F.col("text"))).alias("digest"))


@query("""SELECT doc_id, array_to_string(list_sort(list_filter(['\ufffd', '\u9225', '\u8305', '\u00c3', '\u00c2', '\u00e2\u20ac', '\u934f', '\u5d85', '\u59df', '\u6f12', '\u6dd0'], lambda m: contains(text, m))), ',') AS hits,
 length(regexp_replace(text, '[\\x{4e00}-\\x{9fff}]', '', 'g')) AS chars_without_cjk FROM documents""")
def damaged_text(t):
    """Damaged sequences that occur, and length without CJK."""
    c = F.col("text")
    return t.documents.select("doc_id", F.array_join(X.mojibake_hits(c), ",").alias("hits"), F.length(X.strip_cjk(c)).cast("long").alias("chars_without_cjk"))


@query("""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\\[[0-9,\\-; ]+\\]', ' ', 'g'), '(?i)\\((?:Fig|Table|Eq|Ref)s?\\.?[^\\)]*\\)', ' ', 'g') AS x FROM documents)
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(x, '[ \\t\\n\\r\\f]+', ' ', 'g'), '[ \\t\\n\\r\\f]+([,.;:!?])', '\\1', 'g'))) AS digest FROM a""")
def without_citations(t):
    """Digest of the text without citations and figure references."""
    return t.documents.select("doc_id", F.md5(X.strip_citations(F.col("text"))).alias("digest"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
h AS (SELECT doc_id, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g'), '^#{1,6}[ \\t]+', ''), '^\\d+(\\.\\d+)*\\.?[ \\t]+', ''), '^[ :-]+|[ :-]+$', '', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g')) AS h FROM l)
SELECT h AS heading, count(*) AS n, count(DISTINCT doc_id) AS docs FROM h WHERE h <> '' GROUP BY h HAVING count(DISTINCT doc_id) >= 5""")
def shared_headings(t):
    """Normalised lines that five documents or more hold."""
    h = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", X.normalize_heading(F.col("line")).alias("heading"))
    return h.where("heading <> ''").groupBy("heading").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs")).where("docs >= 5")


@query("""SELECT doc_id, CAST(len(regexp_extract_all(trim(text), '[.!?](?:[ \\t\\n\\r\\f]|$)')) AS INTEGER) AS terminal,
 CAST(len(list_filter(string_split_regex(text, '[.!?\u3002\uff01\uff1f]+'), lambda p: trim(regexp_replace(p, '[ \\t\\n\\r\\f]+', ' ', 'g')) <> '')) AS INTEGER) AS parts FROM documents""")
def sentence_counts(t):
    """Sentences by marks before blanks, and by parts between marks."""
    c = F.col("text")
    return t.documents.select("doc_id", X.terminal_marks(c).alias("terminal"), X.split_count(c).alias("parts"))


@query("""WITH a AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g')) AS x FROM documents)
SELECT doc_id, md5(CASE WHEN x = '' THEN '' ELSE rtrim(regexp_replace(regexp_replace(x, '(?:\\.[ ]*)+\\.$', '.'), '[.!?]$', '')) || '.' END) AS forced,
 CASE WHEN length(x) <= 160 THEN x ELSE x[1:157] || '...' END AS preview FROM a""")
def period_and_preview(t):
    """Digest of the text with one period at its end, and a preview of 160 characters."""
    c = F.col("text")
    return t.documents.select("doc_id", F.md5(X.force_period(c)).alias("forced"), X.preview(c).alias("preview"))


@query("""SELECT doc_id, contains(text, '```') OR regexp_matches(text, '(^|\\n)[ \\t\\n\\r\\f]*(#{1,6}[ \\t\\n\\r\\f]+|[-*][ \\t\\n\\r\\f]+|\\d+\\.[ \\t\\n\\r\\f]+)') AS markdown,
 regexp_matches(lower(text), 'i cannot|i can''t|as an ai|i am unable|cannot summarize') AS refusal, contains(text, 'http') AS linked FROM documents""")
def leakage_flags(t):
    """Markdown, refusal and link flags."""
    c = F.col("text")
    return t.documents.select("doc_id", X.has_markdown(c).alias("markdown"), X.has_refusal(c).alias("refusal"), F.contains(c, F.lit("http")).alias("linked"))


@query("""WITH l AS (SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS x FROM pages)
SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \\t\\n\\r\\f]+', ' ', 'g'))) AS digest FROM l""")
def page_text(t):
    """Digest of the text of HTML pages."""
    return t.pages.select("page_id", F.md5(X.html_to_text(F.col("html"))).alias("digest"))


@query("""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS raw FROM documents),
k AS (SELECT doc_id, raw, lower(regexp_replace(trim(regexp_replace(raw, '[ \\t\\n\\r\\f]+', ' ', 'g'))[1:80], '^[^a-zA-Z]+|[^a-zA-Z]+$', '', 'g')) AS term FROM w)
SELECT term, count(*) AS n FROM k WHERE length(term) <= 50 AND regexp_matches(term, '^[A-Za-z]+(?:[''-][A-Za-z]+)*$') GROUP BY term HAVING count(*) >= 20""")
def lookup_terms(t):
    """Dictionary terms that occur twenty times or more."""
    raw = spread(t.documents.select("text")).select(F.explode(F.split("text", " ")).alias("raw")).groupBy("raw").agg(F.count("*").alias("n"))
    k = computed(raw, term=X.lookup_term(F.col("raw")))  # once for each distinct piece
    return k.where(X.is_single_word(F.col("term"))).groupBy("term").agg(F.sum("n").alias("n")).where("n >= 20")


_PARAGRAPHS = "WITH p AS (SELECT doc_id, generate_subscripts(s, 1) AS pos, trim(unnest(s)) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))"


@query(_PARAGRAPHS + """, f AS (SELECT doc_id, pos,
  p = '' OR (len(regexp_extract_all(p, '\\S+')) <= 12 AND (regexp_matches(p, '^(?:[IVXLCM]+\\.?|[0-9]+\\.?)$') OR regexp_matches(p, '^(?:[IVXLCM]+\\.?[ \\t]+)?[A-Z0-9][A-Z0-9 \\-:/,&()]+$'))) AS heading,
  length(p) < 40 OR regexp_matches(lower(p), '^https?://') OR len(regexp_extract_all(p, '@')) >= 2 OR CASE WHEN len(regexp_extract_all(p, '\\S')) = 0 THEN 0.0 ELSE CAST(len(regexp_extract_all(p, '\\p{L}')) AS DOUBLE) / len(regexp_extract_all(p, '\\S')) END < 0.65
   OR len(regexp_extract_all(p, '[0-9]')) > greatest(20.0, length(p) * CAST(0.2 AS DOUBLE)) AS noise FROM p)
SELECT doc_id, count(*) AS paragraphs, count(*) FILTER (WHERE heading) AS headings, count(*) FILTER (WHERE noise) AS noise FROM f GROUP BY doc_id""")
def paragraph_flags(t):
    """Headings and noise among the lines of each document."""
    p = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("p"))
    return p.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.count_if(X.is_upper_heading(F.col("p"))).alias("headings"), F.count_if(X.is_noise_paragraph(F.col("p"))).alias("noise"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'literature review') THEN 'literature_review' WHEN regexp_matches(lower(text), 'research paper|thesis|dissertation') THEN 'research_paper' WHEN contains(lower(text), 'essay') THEN 'essay' WHEN contains(lower(text), 'report') THEN 'report'
 WHEN contains(lower(text), 'abstract') THEN 'abstract' WHEN contains(lower(text), 'presentation') THEN 'presentation' WHEN contains(lower(text), 'proposal') THEN 'proposal' WHEN contains(lower(text), 'annotated bibliography') THEN 'annotated_bibliography' ELSE 'other_assignment_like' END AS task_type,
 CASE WHEN n_chars < 40 THEN 'not_readable_or_empty' WHEN regexp_matches(lower(text), 'i cannot|i can''t|as an ai|i am unable|cannot summarize') THEN 'refusal_or_meta' WHEN regexp_matches(text, '(?s)\\{.*\\}') OR regexp_matches(lower(text), 'main_idea|main idea|summary|key_points|key points') THEN 'likely_format_only_failure'
 WHEN n_chars >= 120 THEN 'ambiguous_but_readable' ELSE 'likely_content_failure' END AS rescue FROM documents""")
def rule_labels(t):
    """Task type and rescue label by ordered rules."""
    c = F.col("text")
    rescue = F.when(F.col("n_chars") < 40, "not_readable_or_empty").when(X.has_refusal(c), "refusal_or_meta").when(c.rlike(r"(?s)\{.*\}") | F.lower(c).rlike("main_idea|main idea|summary|key_points|key points"), "likely_format_only_failure").when(F.col("n_chars") >= 120, "ambiguous_but_readable").otherwise("likely_content_failure")
    return t.documents.select("doc_id", X.task_type(c).alias("task_type"), rescue.alias("rescue"))


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z][a-z''-]*') AS w FROM documents),
s AS (SELECT doc_id, len(w) AS n, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(list_slice(w, i, i + 7), ' '))) AS s FROM w WHERE len(w) >= 80),
c AS (SELECT doc_id, n, s, count(*) AS k FROM s GROUP BY ALL),
r AS (SELECT doc_id, max(n) - 7 AS shingles, CAST(sum(CASE WHEN k > 1 THEN k - 1 ELSE 0 END) AS BIGINT) AS repeated FROM c GROUP BY doc_id)
SELECT doc_id, CAST(shingles AS BIGINT) AS shingles, repeated, repeated > 20 AND CAST(repeated AS DOUBLE) / shingles > 0.18 AS bad FROM r""")
def repeated_shingles(t):
    """Runs of eight tokens that repeat inside a document, and whether they are too many."""
    w = t.documents.select("doc_id", X.tokens(F.col("text")).alias("w")).where(F.size("w") >= 80)
    s = w.select("doc_id", F.transform(F.sequence(F.lit(1), F.size("w") - 7), lambda i: F.xxhash64(F.array_join(F.slice("w", i, 8), " "))).alias("s"))
    n, d = F.size("s").cast("long"), F.size(F.array_distinct("s")).cast("long")
    return s.select("doc_id", n.alias("shingles"), (n - d).alias("repeated"), ((n - d > 20) & ((n - d) / n > 0.18)).alias("bad"))


@query("""WITH e AS (SELECT event_id, value, CAST(event_id AS DOUBLE) / 7 AS sec FROM events)
SELECT event_id, CASE WHEN r >= 3600 THEN printf('%dh %02dm %02ds', r // 3600, r // 60 % 60, r % 60) WHEN r >= 60 THEN printf('%dm %02ds', r // 60, r % 60) ELSE printf('%ds', r) END AS duration
FROM (SELECT event_id, CAST(round_even(sec, 0) AS BIGINT) AS r FROM e)""")
def durations(t):
    """Seconds as hours, minutes and seconds."""
    return t.events.select("event_id", X.format_duration(F.col("event_id").cast("double") / 7).alias("duration"))


@query("""WITH m AS (SELECT max(ts) AS now FROM events), d AS (SELECT event_id, ts, date_diff('second', ts, now) // 60 AS mins FROM events, m)
SELECT event_id, CASE WHEN mins < 1 THEN 'Just now' WHEN mins < 60 THEN mins || 'm ago' WHEN mins < 1440 THEN mins // 60 || 'h ago' WHEN mins < 10080 THEN mins // 1440 || 'd ago' ELSE strftime(ts, '%Y-%m-%d') END AS label FROM d""")
def relative_dates(t):
    """How long before the last event each event was."""
    e = t.events.withColumn("at", F.date_trunc("second", F.col("ts").cast("timestamp")))
    last = e.agg(F.max("at").alias("now"))
    return e.crossJoin(F.broadcast(last)).select("event_id", X.relative_date(F.col("now"), F.col("at")).alias("label"))
