"""Queries over text as it is copied from pages: documents with side boxes, page lines and broken lines put in."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import copied as C
from lectern.functions.text import MERGED_WORDS, QUOTES
from lectern.operators.cuts import computed
from lectern.operators.sequences import spread
from lectern.plans.registry import query

# some lines of each text become boxes, page lines, points, or lose their ends: i counts from 0
_PUT = {11: "'Key points' || chr(10) || x", 17: "'KEY FACTS' || chr(10) || x", 23: "'- ' || left(x, 60) || ';'", 29: "x || chr(10) || 'Page 3 of 9'", 31: "x || '-'", 37: "left(x, 40) || ' [see'", 38: "'above] and ' || x", 41: "'12 ' || x", 43: "chr(10) || 'Key points' || chr(10) || 'one' || chr(10) || chr(10) || '* two' || chr(10) || x"}
_KEPT = "".join(k for k, v in QUOTES.items() if v) + "".join(k for k, v in QUOTES.items() if not v)
_MADE = "array_to_string(list_transform(string_split(text, chr(10)), lambda x, j: CASE (doc_id + j - 1) % 47 " + " ".join(f"WHEN {k} THEN {v}" for k, v in _PUT.items()) + " ELSE x END), chr(10))"


def copied_texts(t):
    d = spread(t.documents.select("doc_id", "text"))
    cases = " ".join(f"WHEN {k} THEN {v}" for k, v in _PUT.items())
    return computed(d, made=F.expr(f"array_join(transform(split(text, '\\n'), (x, j) -> CASE (doc_id + j) % 47 {cases} ELSE x END), '\\n')")).select("doc_id", F.col("made").alias("text"))


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {_q(pattern)})"


_TITLE = f"(NOT {_has('l', C.ENDED)} AND ({_has('l', C.TITLES)} OR lower(l) IN {C.SECTIONS}))"
_MERGED = "o"
for _bad, _good in MERGED_WORDS.items():
    _MERGED = f"regexp_replace({_MERGED}, '(?i)\\b{_bad}\\b', '{_good}', 'g')"


@query(rf"""WITH RECURSIVE b AS (SELECT doc_id, trim(regexp_replace(regexp_replace(translate(replace(replace({_MADE}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), {_q(_KEPT)}, {_q("".join(QUOTES[k] for k in _KEPT))}), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10)) AS t FROM documents),
l AS (SELECT doc_id, trim(unnest(s)) AS l, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split(t, chr(10)) AS s FROM b)),
f AS (SELECT *, len(regexp_extract_all(l, '\S+')) AS n, lower(l) AS t FROM l),
g AS (SELECT doc_id, i, l, {_TITLE} AS title, {_has("l", "^[-*]")} OR n <= {C.WORDS} AND (l LIKE '%;' OR NOT {_has("l", C.ENDED)}) AS point, t = '{C.BOX}' AS box,
  t IN {C.FRAGMENTS} OR {_has("t", C.PAGE)} OR {_has("t", C.CONTACT)} OR {_has("t", C.ADDRESS)} AND n <= 22 OR {_has("t", C.PHONE)} AND n <= 12 AND {_has("t", C.PHONE_WORDS)} OR {_has("t", C.LINK)} OR n <= 12 AND {_has("t", C.LABELLED)} OR n <= 18 AND {_has("t", C.NOTICE)}
  OR n <= 8 AND contains(t, 'open access') OR n <= 22 AND {_has("t", C.LOCATIONS)} AND ({_has("t", C.PLACES)} OR len(t) - len(replace(t, ',', '')) >= 2) OR n <= 5 AND {_has("t", C.TAIL)} OR n <= 8 AND {_has("t", C.TERMS)} AS page FROM f),
s(doc_id, i, lft, kept, l) AS (SELECT doc_id, CAST(0 AS BIGINT), 0, false, '' FROM b UNION ALL
  SELECT g.doc_id, g.i, CASE WHEN g.l = '' THEN lft WHEN lft > 0 AND point AND NOT title THEN lft - 1 WHEN box THEN {C.REACH} ELSE 0 END,
    CASE WHEN g.l = '' THEN true WHEN lft > 0 AND point AND NOT title OR box THEN false ELSE NOT page END, g.l FROM s JOIN g ON g.doc_id = s.doc_id AND g.i = s.i + 1),
k AS (SELECT doc_id, l, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, coalesce(lag(l) OVER (PARTITION BY doc_id ORDER BY i), '') AS p FROM s WHERE kept),
m AS (SELECT *, p <> '' AND l <> '' AND NOT {_TITLE} AS free FROM k),
j(doc_id, i, l, how, opn) AS (SELECT doc_id, CAST(0 AS BIGINT), '', 'n', false FROM b UNION ALL
  SELECT doc_id, i, l, how, {_has("l", C.OPENS)} OR how <> 'n' AND opn AND NOT contains(l, ']') FROM (SELECT m.doc_id, m.i, m.l, opn,
    CASE WHEN NOT free THEN 'n' WHEN p LIKE '%-' THEN 'h' WHEN opn AND {_has("m.l", C.CLOSES)} THEN 'c' WHEN {_has("p", C.NUMBER_BEFORE)} AND {_has("m.l", C.NUMBER)} THEN 's' WHEN {_has("p", C.ENDED)} THEN 'n' WHEN {_has("m.l", C.GOES_ON)} THEN 's' ELSE 'n' END AS how
    FROM j JOIN m ON m.doc_id = j.doc_id AND m.i = j.i + 1)),
o AS (SELECT doc_id, string_agg(CASE WHEN i = 1 THEN '' WHEN how = 'n' THEN chr(10) WHEN how = 's' THEN ' ' ELSE '' END || CASE WHEN nx = 'h' THEN left(l, length(l) - 1) ELSE l END, '' ORDER BY i) AS o
  FROM (SELECT *, lead(how) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM j WHERE i > 0) GROUP BY doc_id),
r AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_MERGED}, '\bthe(mean|same|following|first|second)\b', 'the \1', 'g'), '\bis(more|less|likely|not)\b', 'is \1', 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10)) AS r FROM o)
SELECT b.doc_id, length(coalesce(r, '')) AS n_chars, len(string_split(coalesce(r, ''), chr(10))) AS n_lines, md5(coalesce(r, '')) AS digest FROM b LEFT JOIN r ON r.doc_id = b.doc_id""")
def cleaned_copies(t):
    """Texts copied from pages, cleaned: characters, lines and digest of what is left."""
    d = computed(copied_texts(t), r=C.clean_copied(F.col("text")))
    return d.select("doc_id", F.length("r").cast("long").alias("n_chars"), F.size(F.split("r", "\n")).cast("long").alias("n_lines"), F.md5("r").alias("digest"))
