"""Queries over predicates on lines, sentences and excerpts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import predicates as P
from lectern.functions import text as X
from lectern.operators.cuts import computed
from lectern.operators.sequences import spread
from lectern.plans.registry import query

_LINES = "WITH l AS (SELECT doc_id, trim(lower(line)) AS t, len(regexp_extract_all(line, '\\S+')) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents))"


@query(_LINES + """ SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE regexp_matches(t, '^review$|current opinion|^volume\\s+\\d+|^issue\\s+\\d+|^number\\s+\\d+|^pages?\\s+\\d+|^-?\\s*\\d+\\s*-?$|^\\d+\\s*/\\s*\\d+$') OR regexp_matches(t, '^(e-?mail|contact|correspondence)\\s*:|^correspondence\\s+(to|author)([^a-z0-9_]|$)|^(tel\\.?|telephone|fax)\\s*:')
 OR (regexp_matches(t, '[a-z0-9_.%+-]+@[a-z0-9_.-]+\\.[a-z]{2,}') AND n <= 22) OR (regexp_matches(t, '\\+?\\d[\\d\\s().-]{6,}\\d') AND n <= 12 AND regexp_matches(t, 'tel|fax')) OR regexp_matches(t, '^https?://\\S+$')) AS metadata FROM l GROUP BY doc_id""")
def metadata_lines(t):
    """Lines of each document that are page furniture or contacts."""
    l = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return l.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(P.is_metadata_line(F.col("line"))).alias("metadata"))


@query("""SELECT doc_id, regexp_matches(lower(text), 'review questions|problems & exercises|problems and exercises|about the authors|senior contributing authors|table of contents') OR len(regexp_extract_all(text, '(^|[^A-Za-z0-9_])[a-d]\\.\\s')) >= 6 OR len(regexp_extract_all(text, '[?]')) >= 4 OR regexp_matches(lower(text)[1:400], 'preface|regents of|all rights reserved') AS exercises,
 len(regexp_extract_all(lower(text), 'http')) >= 2 OR coalesce(list_max(list_transform(list_distinct(regexp_extract_all(text, '(?:^|[^A-Za-z0-9_])([A-Za-z][0-9]{5,})', 1)), lambda x: len(list_filter(regexp_extract_all(text, '(?:^|[^A-Za-z0-9_])([A-Za-z][0-9]{5,})', 1), lambda y: y = x)))), 0) >= 3 AS excerpt_issue FROM documents""")
def excerpt_issues(t):
    """Exercise pages, and excerpts with links or repeated codes."""
    c = F.col("text")
    return t.documents.select("doc_id", P.is_exercise_page(c).alias("exercises"), P.has_excerpt_issue(c).alias("excerpt_issue"))


@query()
def prose_flags(t):
    """Bad lines and sentences, list-like documents, and whether the whole text would do as a window."""
    c, flat, lines = F.col("text"), F.col("flat"), F.col("lines")
    d = computed(spread(t.documents.select("doc_id", "text")), flat=X.collapse_spaces(c), lines=F.split(c, "\n"))
    return d.select(
        "doc_id", F.size(F.filter(lines, P.is_bad_line)).alias("bad_lines"), F.size(F.filter(lines, P.is_bad_sentence)).alias("bad_sentences"),
        P.is_list_like(c).alias("list_like"), P.is_good_window(flat, X.word_count(c), X.terminal_marks(c)).alias("good_window"),
    )
