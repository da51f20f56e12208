"""Audit of an accepted set of message records: one typed parse of each, then every issue as a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.paragraphs import bound
from lectern.functions.text import collapse_spaces
from lectern.operators.cuts import computed
from lectern.operators.gates import LABEL_KEYS, ROLES, _is

# fixed values: abbreviations with a period that a sentence may end with, by what may follow them
ABBREVIATIONS = ("a.m", "apr", "aug", "c", "dec", "dept", "dr", "e.g", "etc", "feb", "fig", "gov", "i.e", "inc", "jan", "jul", "jun", "ltd", "mar", "mr", "mrs", "ms", "no", "nov", "oct", "p.m", "prof", "sep", "sept", "st", "u.k", "u.s", "vs", "www")
TITLES = ("dr", "fig", "mr", "mrs", "ms", "no", "prof", "st", "vs")
NEVER = ("a.m", "e.g", "i.e", "p.m", "www")
STARTERS = ("An", "It", "The", "These", "They", "This", "Those")
WEB = "com|edu|gov|mil|net|org"
# fixed values: phrases of refusals, chat and markup in an answer
ARTIFACTS = [r"```", r"^\s*here (?:is|are)\b", r"\bas an ai\b", r"\bi cannot\b", r"\bi can(?:'|no)t\b", r"\bsorry\b", r"\bmarkdown\b", r"\bjson\s*:\s*\{", r"\bI will\b"]
# fixed values: limits in characters, words and likeness
IDEA, POINT, SHORT, LONG, USER, RATIO, ALIKE, ALIKE_IDEA = (30, 360), (18, 260), 35, 155, 250, 0.30, 0.72, 0.75

_KEPT, _ENDS = "․", "‥"


def _any_of(words: tuple[str, ...]) -> str:
    return "(?i:" + "|".join(w.replace(".", r"\.") for w in words) + ")"


#: Patterns in order, with what takes their place: periods that end nothing become _KEPT. No look-around, so that
#: every engine reads them alike; those that may overlap stand twice.
SCANNER = [
    (rf"(^|[\s.!?])((?i:u\.k|u\.s))\.(\s+(?:{'|'.join(STARTERS)})(?:[^A-Za-z-]|$))", (1, 2, _ENDS, 3)),
    (rf"(^|[\s.!?])((?i:u\.k|u\.s))\.", (1, 2, _KEPT)),
    (rf"(^|[\s.!?])({_any_of(NEVER + TITLES)})\.", (1, 2, _KEPT)),
    (rf"(^|[\s.!?])({_any_of(ABBREVIATIONS)})\.(\s+[a-z])", (1, 2, _KEPT, 3)),
    (r"(^|[\s.!?])((?i:gov))\.([^\s]|\s+[^A-Za-z]|\s*$)", (1, 2, _KEPT, 3)),
    (rf"([\p{{L}}\p{{N}}_]\.(?i:{WEB}))\.", (1, _KEPT)),
    (rf"\.((?i:{WEB}))([^\p{{L}}]|$)", (_KEPT, 1, 2)),
    *[(r"([0-9])\.([0-9])", (1, _KEPT, 2))] * 2,
    *[(r"(\p{L})\.(\p{L})", (1, _KEPT, 2))] * 2,
]
UNIT = "[^.!?]*[.!?]|[^.!?]+$"


def audit_sentences(text: Column) -> Column:
    """Sentences by a second scanner, with rules of its own, to check the first ones' work."""
    t = collapse_spaces(text)
    for pattern, put in SCANNER:
        t = F.regexp_replace(t, pattern, "".join(f"${x}" if isinstance(x, int) else x for x in put))
    units = F.regexp_extract_all(F.translate(t, _ENDS, "."), F.lit(f"({UNIT})"), F.lit(1))
    return F.filter(F.transform(units, lambda u: F.trim(F.translate(u, _KEPT, "."))), lambda u: u != "")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+(?:[-'][a-z0-9]+)?)"), F.lit(1))


def _alike(a: Column, b: Column) -> Column:
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(both / either)


def _issue(when: Column, severity: str, code: str, number: Column | None = None) -> Column:
    at = F.lit(None).cast("int") if number is None else number.cast("int")
    return F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), at.alias("number")))


def parsed_records(records: DataFrame) -> DataFrame:
    """slug, line, and of each record: valid, roles, system, user, answer, and of the answer: keys, idea, points, said.

    What isn't there, or is of another type, is null; nothing is cast.
    """
    def string(v: Column) -> Column:
        return F.when(_is(v, "STRING"), F.try_variant_get(v, "$", "string"))

    d = computed(records.select("slug", "line", "record"), v=F.try_parse_json("record"))
    m = F.try_variant_get("v", "$.messages", "array<variant>")
    d = computed(d, m=F.when(_is(F.try_variant_get("v", "$.messages", "variant"), "ARRAY"), m))
    content = [string(F.try_variant_get(F.get("m", F.lit(i)), "$.content", "variant")) for i in range(3)]
    roles = F.transform("m", lambda x: string(F.try_variant_get(x, "$.role", "variant")))
    d = computed(d.select("slug", "line", F.col("v").isNotNull().alias("valid"), "m"), roles=roles, system=content[0], user=content[1], answer=content[2]).drop("m")
    d = computed(d, a=F.try_parse_json("answer"))
    idea, points = (F.try_variant_get("a", f"$.{k}", "variant") for k in LABEL_KEYS)
    items = F.when(_is(points, "ARRAY"), F.try_variant_get("a", "$.key_points", "array<variant>"))
    d = computed(d, keys=F.when(F.col("a").isNotNull(), F.coalesce(F.json_object_keys("answer"), F.array().cast("array<string>"))), idea=string(idea), points=F.transform(items, string))
    counted = F.transform("points", lambda p: F.struct(p.alias("text"), F.size(audit_sentences(p)).alias("sentences"), _words(p).alias("words")))
    return computed(d.drop("a"), said=audit_sentences(F.col("idea")), counted=counted).drop("points").withColumnRenamed("counted", "points")


def accepted_issues(records: DataFrame, sources: DataFrame, prompt: str) -> DataFrame:
    """slug, line, severity, code, number: a row for each issue of accepted records.

    records: slug, line, record (JSON of three messages, the last one's content the label's JSON); sources:
    slug, sha (SHA-256 of a source text), which accepted user texts must be among. number is the point, or
    10 times the first and the second of two alike. A record that can't be read further has only the issues
    up to there. Of records of one slug and user text all but the one with the least line are duplicates.
    Records that aren't JSON objects, null ones too, are invalid.
    """
    d = parsed_records(records)
    shaped = F.coalesce(F.size("roles") == 3, F.lit(False))
    has_user = shaped & (F.trim(F.coalesce("user", F.lit(""))) != "")
    has_answer = has_user & (F.trim(F.coalesce("answer", F.lit(""))) != "")
    parsed, told = F.col("keys").isNotNull(), F.col("idea").isNotNull()
    listed = has_answer & parsed & told & F.col("points").isNotNull()
    d = computed(d, sha=F.when(has_answer, F.sha2("user", 256)), n_words=F.when(listed, F.size(_words(F.concat_ws(" ", "idea", F.array_join(F.transform("points", lambda p: F.coalesce(p["text"], F.lit(""))), " "))))), u_words=F.size(_words(F.col("user"))))
    known = sources.select(F.col("slug").alias("s_slug"), F.col("sha").alias("s_sha")).distinct()
    first = d.where("sha is not null").groupBy("slug", "sha").agg(F.min("line").alias("first")).withColumnsRenamed({"slug": "f_slug", "sha": "f_sha"})
    first = first.join(known, F.expr("f_slug <=> s_slug and f_sha = s_sha"), "left").select("f_slug", "f_sha", "first", F.col("s_sha").isNotNull().alias("known"))
    d = d.join(first, F.expr("slug <=> f_slug and sha = f_sha"), "left")
    idea, points, said, answer = F.col("idea"), F.col("points"), F.col("said"), F.trim("answer")
    yes = lambda c: F.coalesce(c, F.lit(False))

    def of_points(when, severity: str, code: str) -> Column:
        return F.transform(points, lambda p, i: _issue(listed & yes(when(p)), severity, code, i + 1))

    def pair(i: int, j: int) -> Column:
        strings = (F.size(points) == 4) & ~F.exists(points, lambda p: p["text"].isNull())
        alike = F.when(strings, _alike(F.get(points, F.lit(i))["words"], F.get(points, F.lit(j))["words"])) >= ALIKE
        return _issue(listed & yes(alike), "major", "similar_key_points", F.lit(10 * (i + 1) + j + 1))

    ratio = F.col("n_words") / F.col("u_words")
    main = lambda x: bound(x, lambda s: _alike(_words(F.get(s, F.lit(0))), _words(F.get(s, F.lit(1)))))
    whole = F.array(
        _issue(~F.col("valid"), "critical", "outer_json_invalid"),
        _issue(F.col("valid") & ~shaped, "critical", "bad_messages_shape"),
        _issue(shaped & ~yes(F.to_json("roles") == F.to_json(F.array(*[F.lit(r) for r in ROLES]))), "critical", "bad_roles"),
        _issue(shaped & ~yes(F.col("system") == prompt), "major", "system_prompt_drift"),
        _issue(shaped & ~has_user, "critical", "empty_user"),
        _issue(has_user & ~has_answer, "critical", "empty_assistant"),
        _issue(has_answer & ~yes(F.col("known")), "critical", "accepted_not_in_source"),
        _issue(has_answer & yes(F.col("line") > F.col("first")), "critical", "duplicate_accepted_source"),
        _issue(has_answer & ~(answer.startswith("{") & answer.endswith("}")), "critical", "assistant_not_single_json_object_text"),
        _issue(has_answer & ~parsed, "critical", "assistant_json_invalid"),
        _issue(has_answer & parsed & (F.to_json("keys") != F.to_json(F.array(*[F.lit(k) for k in LABEL_KEYS]))), "critical", "assistant_key_order_or_keys_bad"),
        _issue(has_answer & parsed & ~told, "critical", "main_idea_not_string"),
        _issue(has_answer & parsed & told & points.isNull(), "critical", "key_points_not_list"),
        _issue(listed & (F.size(said) != 2), "major", "independent_main_sentence_count"),
        _issue(listed & (F.length(idea) < IDEA[0]), "minor", "main_idea_very_short"),
        _issue(listed & (F.length(idea) > IDEA[1]), "minor", "main_idea_very_long"),
        _issue(listed & (F.size(points) != 4), "critical", "key_points_count"),
        _issue(listed & (F.size(said) == 2) & (main(said) >= ALIKE_IDEA), "major", "similar_main_sentences"),
        _issue(listed & (F.col("n_words") < SHORT), "major", "assistant_too_short"),
        _issue(listed & (F.col("n_words") > LONG), "minor", "assistant_long"),
        _issue(listed & (F.col("u_words") >= USER) & (ratio > RATIO), "minor", "summary_ratio_high"),
        *[pair(i, j) for i in range(4) for j in range(i + 1, 4)],
        *[_issue(listed & F.col("answer").rlike(f"(?im){p}"), "major", "assistant_artifact_or_refusal_pattern", F.lit(i + 1)) for i, p in enumerate(ARTIFACTS)],
    )
    text = lambda p: p["text"]
    each = [
        of_points(lambda p: text(p).isNull(), "critical", "key_point_not_string"),
        of_points(lambda p: text(p).isNotNull() & (p["sentences"] != 1), "major", "independent_key_point_sentence_count"),
        of_points(lambda p: F.length(text(p)) < POINT[0], "minor", "key_point_very_short"),
        of_points(lambda p: F.length(text(p)) > POINT[1], "minor", "key_point_very_long"),
        of_points(lambda p: ~F.trim(text(p)).rlike("[.!?]$"), "minor", "key_point_no_terminal_punctuation"),
    ]
    none = F.array().cast("array<struct<severity:string,code:string,number:int>>")
    found = F.filter(F.concat(whole, *[F.coalesce(e, none) for e in each]), lambda x: x.isNotNull())
    return d.select("slug", "line", F.inline(found))


def issue_summary(issues: DataFrame, examples: int = 5) -> DataFrame:
    """severity, code, n, records, examples: counts of each code and its first records, by line and slug."""
    one = issues.groupBy("severity", "code", "slug", "line").agg(F.count("*").alias("k"))
    counts = one.groupBy("severity", "code").agg(F.sum("k").alias("n"), F.count("*").alias("records"))
    # a window of few rows is limited before its exchange, so no code's records meet in one task
    w = Window.partitionBy("severity", "code").orderBy("line", "slug")
    few = one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= examples).groupBy("severity", "code").agg(F.array_sort(F.collect_list(F.struct("line", "slug"))).alias("f"))
    return counts.join(few, ["severity", "code"]).select("severity", "code", "n", "records", F.transform("f", lambda x: F.concat_ws(":", x["slug"], x["line"])).alias("examples"))
