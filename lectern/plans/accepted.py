"""Queries over accepted records: messages made of documents, of which each kind of fault is in some."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import accepted as A
from lectern.operators.cuts import computed
from lectern.plans.registry import query

PROMPT = "Summarise."
_TINY = "Gh ij kl mn op qr."

# of w, the first words of a text, by the remainder k of its id
_IDEA = "CASE k WHEN 14 THEN i1 WHEN 15 THEN 'Ab. Cd.' WHEN 16 THEN concat(repeat(concat(a1, ' '), 9), 'it. ', i2) WHEN 24 THEN concat(i1, ' ', i1) WHEN 30 THEN concat('At 3.5 p.m. Dr. ', i1, ' ', i2) ELSE concat(i1, ' ', i2) END"
_ONE = "CASE k WHEN 19 THEN concat(p1, ' ', p2) WHEN 20 THEN 'Ab cd.' WHEN 21 THEN concat(repeat(concat(a3, ' '), 12), 'end.') WHEN 22 THEN a3 WHEN 25 THEN concat('As an AI ', p1) WHEN 26 THEN concat('``` ', p1) WHEN 28 THEN concat(repeat(concat(a3, ' '), 25), 'end.') WHEN 29 THEN concat(repeat(concat(a3, ' '), 14), 'end.') ELSE p1 END"
_LIST = """concat('["', one, '","', CASE k WHEN 23 THEN p1 ELSE p2 END, '","', p3, '","', p4, '"', CASE k WHEN 17 THEN concat(',"', i2, '"') WHEN 18 THEN ',7' ELSE '' END, ']')"""
_BODY = f"""CASE k WHEN 6 THEN ' ' WHEN 10 THEN '{{"main_idea" "x"}}' WHEN 11 THEN concat('{{"key_points":', points, ',"main_idea":"', idea, '"}}') WHEN 12 THEN concat('{{"main_idea":5,"key_points":', points, '}}')
  WHEN 13 THEN concat('{{"main_idea":"', idea, '","key_points":{{"1":"a"}}}}') WHEN 9 THEN concat('note {{"main_idea":"', idea, '","key_points":', points, '}}')
  WHEN 27 THEN '{{"main_idea":"Ab cd ef gh ij kl. Mn op qr st uv wx.","key_points":["{_TINY}","Ab cd ef gh ij kl mn.","St uv wx yz ab cd.","Ef gh ij kl mn op."]}}' ELSE concat('{{"main_idea":"', idea, '","key_points":', points, '}}') END"""
_USER = "CASE k WHEN 5 THEN '  ' WHEN 7 THEN concat(text, ' x') ELSE text END"
_PARTS = {"a1": (1, 8), "a2": (9, 8), "a3": (17, 6), "a4": (23, 6), "a5": (29, 6), "a6": (35, 6)}
_NAMES = ("i1", "i2", "p1", "p2", "p3", "p4")
_MADE = ", ".join(f"concat({a}, '.') AS {n}" for a, n in zip(_PARTS, _NAMES, strict=True))


def accepted_records(t):
    """slug, line, record."""
    w = F.slice(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)), 1, 60)
    d = computed(t.documents.select("doc_id", "source", "text", (F.col("doc_id") % 31).alias("k")), w=w)
    d = computed(d, **{n: F.array_join(F.slice("w", a, m), " ") for n, (a, m) in _PARTS.items()})
    d = d.selectExpr("*", *[f"concat({a}, '.') AS {n}" for a, n in zip(_PARTS, _NAMES, strict=True)])
    d = d.withColumns({"idea": F.expr(_IDEA), "one": F.expr(_ONE)})
    d = computed(computed(d, points=F.expr(_LIST)), answer=F.expr(_BODY), user=F.expr(_USER))

    def message(role: str, content):
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    k = F.col("k")
    system = F.when(k == 4, "Other.").otherwise(PROMPT)
    all_ = F.array(message("system", system), message("user", F.col("user")), message("assistant", F.col("answer")))
    messages = F.when(k == 2, F.slice(all_, 1, 2)).when(k == 3, F.array(message("system", system), message("assistant", F.col("user")), message("user", F.col("answer")))).otherwise(all_)
    d = computed(d, r=F.to_json(F.struct(messages.alias("messages"))))
    return d.select(F.col("source").alias("slug"), F.col("doc_id").alias("line"), F.expr("CASE k WHEN 1 THEN left(r, length(r) - 5) ELSE r END").alias("record"))


def _scanned_sql(text: str) -> str:
    out = f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"
    for pattern, put in A.SCANNER:
        out = f"regexp_replace({out}, '{pattern.replace(chr(39), chr(39) * 2)}', '{''.join(chr(92) + str(x) if isinstance(x, int) else x for x in put)}', 'g')"
    return f"list_filter(list_transform(regexp_extract_all(replace({out}, '{A._ENDS}', '.'), '{A.UNIT}'), lambda u: trim(replace(u, '{A._KEPT}', '.'))), lambda u: u <> '')"


def _words_sql(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[a-z0-9]+(?:[-''][a-z0-9]+)?')"


def _alike_sql(a: str, b: str) -> str:
    either = f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN {either} = 0 THEN 1.0 ELSE len(list_intersect({a}, {b})) / {either} END"


_PAIRS = [(i, j) for i in range(1, 5) for j in range(i + 1, 5)]
_CHECKS = [
    ("NOT valid", "critical", "outer_json_invalid", "NULL"), ("valid AND NOT shaped", "critical", "bad_messages_shape", "NULL"),
    ("shaped AND roles IS DISTINCT FROM ['system', 'user', 'assistant']", "critical", "bad_roles", "NULL"), (f"shaped AND sys IS DISTINCT FROM '{PROMPT}'", "major", "system_prompt_drift", "NULL"),
    ("shaped AND NOT has_user", "critical", "empty_user", "NULL"), ("has_user AND NOT has_answer", "critical", "empty_assistant", "NULL"),
    ("has_answer AND NOT known", "critical", "accepted_not_in_source", "NULL"), ("has_answer AND again > 1", "critical", "duplicate_accepted_source", "NULL"),
    ("has_answer AND NOT (trim(answer) LIKE '{%' AND trim(answer) LIKE '%}')", "critical", "assistant_not_single_json_object_text", "NULL"), ("has_answer AND NOT parsed", "critical", "assistant_json_invalid", "NULL"),
    ("has_answer AND parsed AND keys IS DISTINCT FROM ['main_idea', 'key_points']", "critical", "assistant_key_order_or_keys_bad", "NULL"), ("has_answer AND parsed AND idea IS NULL", "critical", "main_idea_not_string", "NULL"),
    ("has_answer AND parsed AND idea IS NOT NULL AND pts IS NULL", "critical", "key_points_not_list", "NULL"),
    ("listed AND len(said) <> 2", "major", "independent_main_sentence_count", "NULL"), (f"listed AND length(idea) < {A.IDEA[0]}", "minor", "main_idea_very_short", "NULL"), (f"listed AND length(idea) > {A.IDEA[1]}", "minor", "main_idea_very_long", "NULL"),
    ("listed AND len(pts) <> 4", "critical", "key_points_count", "NULL"), (f"listed AND len(said) = 2 AND {_alike_sql(_words_sql('said[1]'), _words_sql('said[2]'))} >= {A.ALIKE_IDEA}", "major", "similar_main_sentences", "NULL"),
    (f"listed AND n_words < {A.SHORT}", "major", "assistant_too_short", "NULL"), (f"listed AND n_words > {A.LONG}", "minor", "assistant_long", "NULL"), (f"listed AND u_words >= {A.USER} AND n_words / CAST(u_words AS DOUBLE) > {A.RATIO}", "minor", "summary_ratio_high", "NULL"),
    *[(f"listed AND len(pts) = 4 AND len(list_filter(pts, lambda p: p IS NULL)) = 0 AND {_alike_sql(_words_sql(f'pts[{i}]'), _words_sql(f'pts[{j}]'))} >= {A.ALIKE}", "major", "similar_key_points", str(10 * i + j)) for i, j in _PAIRS],
    *[(f"listed AND regexp_matches(answer, '(?im){p.replace(chr(39), chr(39) * 2)}')", "major", "assistant_artifact_or_refusal_pattern", str(i + 1)) for i, p in enumerate(A.ARTIFACTS)],
]
_POINTS = [
    ("p IS NULL", "critical", "key_point_not_string"), (f"len({_scanned_sql('p')}) <> 1", "major", "independent_key_point_sentence_count"), (f"length(p) < {A.POINT[0]}", "minor", "key_point_very_short"),
    (f"length(p) > {A.POINT[1]}", "minor", "key_point_very_long"), ("NOT regexp_matches(trim(p), '[.!?]$')", "minor", "key_point_no_terminal_punctuation"),
]
_parts = ", ".join(f"array_to_string(list_slice(w, {a}, {a + m - 1}), ' ') AS {n}" for n, (a, m) in _PARTS.items())
_ISSUES = f"""WITH d0 AS (SELECT doc_id, source, text, doc_id % 31 AS k, list_slice(regexp_extract_all(lower(text), '[a-z]+'), 1, 60) AS w FROM documents),
d1 AS (SELECT *, {_parts} FROM d0), d2 AS (SELECT *, {_MADE} FROM d1), d3 AS (SELECT *, {_IDEA} AS idea, {_ONE} AS one FROM d2), d4 AS (SELECT *, {_LIST} AS points FROM d3), d5 AS (SELECT *, {_BODY} AS made, {_USER} AS u FROM d4),
d6 AS (SELECT source AS slug, doc_id AS line, k, CAST(to_json({{'messages': list_filter([{{'role': 'system', 'content': CASE k WHEN 4 THEN 'Other.' ELSE '{PROMPT}' END}}, {{'role': CASE k WHEN 3 THEN 'assistant' ELSE 'user' END, 'content': u}}, CASE WHEN k <> 2 THEN {{'role': CASE k WHEN 3 THEN 'user' ELSE 'assistant' END, 'content': made}} END], lambda x: x IS NOT NULL)}}) AS VARCHAR) AS r FROM d5),
d7 AS (SELECT slug, line, CASE k WHEN 1 THEN left(r, length(r) - 5) ELSE r END AS r FROM d6),
d8 AS (SELECT slug, line, coalesce(json_valid(r), false) AS valid, CASE WHEN json_valid(r) THEN r END AS r FROM d7),
d9 AS (SELECT *, coalesce(json_array_length(r, '$.messages') = 3, false) AS shaped, [r ->> '$.messages[0].role', r ->> '$.messages[1].role', r ->> '$.messages[2].role'] AS roles, r ->> '$.messages[0].content' AS sys, r ->> '$.messages[1].content' AS usr, r ->> '$.messages[2].content' AS answer FROM d8),
e0 AS (SELECT *, shaped AND coalesce(trim(usr) <> '', false) AS has_user, has_user AND coalesce(trim(answer) <> '', false) AS has_answer, CASE WHEN json_valid(answer) THEN answer END AS a FROM d9),
e1 AS (SELECT *, a IS NOT NULL AS parsed, json_keys(a) AS keys, CASE WHEN json_type(a, '$.main_idea') = 'VARCHAR' THEN a ->> '$.main_idea' END AS idea, CASE WHEN json_type(a, '$.key_points') = 'ARRAY' THEN list_transform(CAST(a -> '$.key_points' AS JSON[]), lambda x: CASE WHEN json_type(x) = 'VARCHAR' THEN x ->> '$' END) END AS pts,
  sha256(usr) AS sha, row_number() OVER (PARTITION BY slug, CASE WHEN has_answer THEN sha256(usr) ELSE CAST(line AS VARCHAR) END ORDER BY line) AS again FROM e0),
e2 AS (SELECT *, has_answer AND parsed AND idea IS NOT NULL AND pts IS NOT NULL AS listed, {_scanned_sql("idea")} AS said, len({_words_sql("idea || ' ' || array_to_string(list_transform(pts, lambda p: coalesce(p, '')), ' ')")}) AS n_words, len({_words_sql("usr")}) AS u_words,
  (slug, sha) IN (SELECT (source, sha256(text)) FROM documents) AS known FROM e1),
issue AS ({" UNION ALL ".join(f"SELECT slug, line, '{s}' AS severity, '{c}' AS code, CAST({n} AS INTEGER) AS number FROM e2 WHERE {w}" for w, s, c, n in _CHECKS)}
  UNION ALL {" UNION ALL ".join(f"SELECT slug, line, '{s}', '{c}', CAST(i AS INTEGER) FROM (SELECT slug, line, unnest(pts) AS p, generate_subscripts(pts, 1) AS i FROM e2 WHERE listed) WHERE {w}" for w, s, c in _POINTS)})"""


@query(_ISSUES + " SELECT slug, line, severity, code, number FROM issue")
def accepted_issues(t):
    """Every issue of the accepted records."""
    return A.accepted_issues(accepted_records(t), t.documents.select(F.col("source").alias("slug"), F.sha2("text", 256).alias("sha")), PROMPT)


@query(_ISSUES + """, one AS (SELECT severity, code, slug, line, count(*) AS k FROM issue GROUP BY ALL)
SELECT severity, code, CAST(sum(k) AS BIGINT) AS n, count(*) AS records, array_to_string(list_slice(list(slug || ':' || line ORDER BY line, slug), 1, 80), ',') AS examples FROM one GROUP BY severity, code""")
def accepted_issue_summary(t):
    """Issues by severity and code, with the first 80 records of each."""
    return A.issue_summary(accepted_issues(t), 80).withColumn("examples", F.array_join("examples", ","))
