"""Queries over audits: chosen sources, expected counts, quarantine, segments, cards, masks, small predicates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as X
from lectern.operators import audits as A
from lectern.operators import gates as G
from lectern.operators import state as S
from lectern.operators.sequences import number_rows
from lectern.plans.lifecycle import _LABELS, labels_json
from lectern.plans.registry import query


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE lang IN ('en', 'de')")
def chosen_sources(t):
    """Documents of the chosen languages, each of which must occur."""
    return A.chosen(t.documents.select("doc_id", "lang", "source", "n_chars"), "lang", ["en", "de"])


@query("SELECT lang, coalesce(expected, 0) AS expected, coalesce(n, 0) AS n, coalesce(expected, 0) = coalesce(n, 0) AS ok FROM (SELECT lang, count(*) AS n FROM documents WHERE n_chars > 500 GROUP BY 1) FULL JOIN (SELECT lang, count(*) AS expected FROM documents SEMI JOIN labels USING (doc_id) GROUP BY 1) USING (lang)")
def expected_row_counts(t):
    """Rows of each language against the number of labelled ones."""
    d = t.documents.select("doc_id", "lang", "n_chars")
    expected = d.join(t.labels, "doc_id", "left_semi").groupBy("lang").agg(F.count("*").alias("expected"))
    return A.expected_counts(d.where("n_chars > 500"), "lang", expected)


@query("SELECT d.doc_id, d.lang, d.n_chars FROM documents d SEMI JOIN benchmark b ON d.doc_id = b.item_id")
def rows_by_id(t):
    """Rows of the asked ids."""
    return t.documents.select("doc_id", "lang", "n_chars").join(t.benchmark.select(F.col("item_id").alias("doc_id")), "doc_id", "left_semi")


@query("SELECT row_number() OVER (ORDER BY CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END, doc_id) - 1 AS place, doc_id, lang FROM documents")
def domain_order(t):
    """Place of each row by the given order of languages, then by id; numbered by many tasks."""
    rank = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).when(F.col("lang") == "fr", 2).otherwise(3)
    return number_rows(t.documents.select("doc_id", "lang", rank.alias("rank")), ["rank", "doc_id"], name="place").select("place", "doc_id", "lang")


@query("SELECT doc_id, 'accepted' AS origin, n_chars FROM documents SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1) USING (doc_id) UNION ALL SELECT doc_id, 'recovered', n_chars FROM documents SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 0 AND toxic = 0) USING (doc_id)")
def final_merge(t):
    """Accepted rows with the recovered ones after them."""
    d = t.documents.select("doc_id", "n_chars")
    part = lambda condition, origin: d.join(t.labels.where(condition), "doc_id", "left_semi").select("doc_id", F.lit(origin).alias("origin"), "n_chars")
    return part("quality = 1", "accepted").unionByName(part("quality = 0 and toxic = 0", "recovered"))


@query("SELECT lang || '-' || doc_id AS id, source AS dataset, md5(text) AS text_digest, n_chars AS chars, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')) AS words, 'rules' AS generator FROM documents")
def raw_records(t):
    """Rows in the form of raw output records."""
    d = t.documents
    return d.select(F.concat_ws("-", "lang", F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("dataset"), F.md5("text").alias("text_digest"), F.col("n_chars").alias("chars"), F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("words"), F.lit("rules").alias("generator"))


@query("""WITH q AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN doc_id % 3 = 0 THEN 'weak summary' ELSE 'weak points' END AS reason, CASE WHEN doc_id % 2 = 0 THEN 'judge' ELSE 'gate' END AS stage FROM labels WHERE quality = 0 OR toxic = 1),
r AS (SELECT * FROM q UNION ALL SELECT * FROM q WHERE doc_id % 5 = 0), s AS (SELECT doc_id FROM documents WHERE lang <> 'fr')
SELECT 'issue' AS kind, 'not_in_source' AS name, count(*) AS n FROM r ANTI JOIN s USING (doc_id) UNION ALL SELECT 'issue', 'duplicate_source', count(*) - count(DISTINCT doc_id) FROM r
UNION ALL SELECT 'stage', stage, count(*) FROM r GROUP BY stage UNION ALL SELECT 'reason', reason, count(*) FROM r GROUP BY reason""")
def quarantine_audit(t):
    """Quarantined rows against the source, their last stages and commonest reasons."""
    k = F.col("doc_id")
    reason = F.when(F.col("toxic") == 1, "toxic").when(k % 3 == 0, "weak summary").otherwise("weak points")
    q = t.labels.where("quality = 0 or toxic = 1").select("doc_id", reason.alias("reason"), F.when(k % 2 == 0, "judge").otherwise("gate").alias("stage"))
    return A.quarantine_audit(q.unionAll(q.where(k % 5 == 0)), t.documents.where("lang <> 'fr'"), ["doc_id"], "reason", "stage")


@query("""WITH d AS (SELECT doc_id AS k, list_transform(range(1, 21), lambda i: 1 + (doc_id + i) % 15) AS n FROM documents),
x AS (SELECT k, list_sum(n) AS total, CASE WHEN k % 11 = 4 THEN 100 ELSE 0 END + CASE WHEN k % 19 = 5 THEN list_sum(n[11:15]) - list_sum(n[16:20]) ELSE 0 END AS delta FROM d)
SELECT k AS doc_id, array_to_string(list_filter([CASE WHEN k % 7 = 3 THEN 'segment_ids' END, CASE WHEN k % 11 = 4 THEN 'word_count' END, CASE WHEN k % 17 = 9 THEN 'not_increasing' END, CASE WHEN k % 13 = 6 THEN 'range_order' END, CASE WHEN k % 19 = 5 THEN 'duplicate_content' END,
 CASE WHEN k % 13 = 6 THEN 'duplicated_sentences' END, CASE WHEN k % 5 = 2 THEN 'missing_sentences' END, CASE WHEN abs(delta) > greatest(3, floor(total * 0.05)) THEN 'total_words' END], lambda c: c IS NOT NULL), ',') AS issues FROM x""")
def segment_checks(t):
    """What is wrong with documents' segments, of which doc_id decides the faults."""
    k = F.col("doc_id")
    n = lambda i: (1 + (k + i) % 15).cast("int")
    sentences = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.struct(i.alias("sentence_id"), n(i).alias("word_count"), F.lit(False).alias("is_reference")))

    def segment(i: int):
        of = lambda j: F.sequence(F.lit(5 * j - 4), F.lit(5 * j))
        ids = of(i)
        if i == 2:
            ids = F.when(k % 13 == 6, F.concat(F.array(F.lit(1)), ids)).otherwise(ids)
        if i == 3:
            ids = F.when(k % 17 == 9, F.reverse(ids)).otherwise(ids)
        if i == 4:
            ids = F.when(k % 5 == 2, F.slice(ids, 1, 4)).otherwise(ids)
        written = F.when(k % 19 == 5, of(3)).otherwise(of(4)) if i == 4 else of(i)
        words = F.aggregate(written, F.lit(0), lambda a, j: a + n(j))
        content = F.array_join(F.transform(written, lambda j: F.trim(F.repeat(F.concat(F.lit("w"), j.cast("string"), F.lit(" ")), n(j)))), " ")
        stated = F.when(k % 11 == 4, words + 100).otherwise(words) if i == 1 else words
        number = F.when(k % 7 == 3, 9).otherwise(2) if i == 2 else F.lit(i)
        return F.struct(number.alias("segment_id"), content.alias("content"), stated.alias("word_count"), ids.alias("sentence_ids"))

    d = t.documents.select("doc_id", F.array(*[segment(i) for i in (1, 2, 3, 4)]).alias("segments"), sentences.alias("sentences"))
    return d.select("doc_id", F.array_join(A.segment_issues(F.col("segments"), F.col("sentences")), ",").alias("issues"))


@query("""WITH c AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN ' Background. ' WHEN 1 THEN '' WHEN 2 THEN 'Works  cited' ELSE split_part(text, ' ', 1) END AS v, CASE WHEN doc_id % 7 = 0 THEN ' ' WHEN doc_id % 7 = 1 THEN 'As shown in [12].' ELSE 'A plain sentence.' END AS s FROM documents),
n AS (SELECT doc_id, trim(regexp_replace(v, '[ \\t\\n\\r\\f]+', ' ', 'g'), ' .') AS v, trim(s) AS s FROM c)
SELECT doc_id, CASE WHEN v = '' THEN 'empty_viewpoint' WHEN s = '' THEN 'empty_summary' WHEN lower(v) IN ('background', 'discussion', 'method', 'result', 'general', 'unknown', 'references', 'bibliography', 'works cited') THEN 'generic_viewpoint'
 WHEN regexp_matches(v || ' ' || s, 'https?://|www\\.|\\[[^\\]]+\\]') THEN 'link_or_citation' END AS issue FROM n""")
def card_checks(t):
    """Why cards of a viewpoint and a summary are rejected."""
    k = F.col("doc_id")
    v = F.when(k % 5 == 0, " Background. ").when(k % 5 == 1, "").when(k % 5 == 2, "Works  cited").otherwise(F.split_part("text", F.lit(" "), F.lit(1)))
    s = F.when(k % 7 == 0, " ").when(k % 7 == 1, "As shown in [12].").otherwise("A plain sentence.")
    return t.documents.select("doc_id", A.card_issue(v, s).alias("issue"))


@query("""WITH d AS (SELECT doc_id, doc_id % 3 > 0 AS used, ['', 'sentence_range', 'chunked_sentence_range', 'local_fallback', 'chunked_mixed_fallback'][doc_id % 5 + 1] AS mode, ['ok', 'preprocessing_failed', 'local_segmentation_fallback', 'ai_segmentation_failed', 'partial_ai_segmentation_failed', 'empty_text', 'other'][doc_id % 7 + 1] AS reason FROM documents)
SELECT doc_id, CASE WHEN NOT used THEN 'processed' WHEN reason = 'preprocessing_failed' THEN 'not_segmented' WHEN reason IN ('local_segmentation_fallback', 'ai_segmentation_failed') THEN 'segmented_locally' WHEN reason = 'partial_ai_segmentation_failed' THEN 'partly_local' ELSE 'basic_result' END AS notice,
 CASE WHEN mode IN ('sentence_range', 'chunked_sentence_range') AND NOT used THEN 'ai' WHEN mode = 'local_fallback' THEN mode WHEN mode = 'chunked_mixed_fallback' THEN 'mixed' WHEN reason = 'preprocessing_failed' THEN 'single_block_fallback' WHEN reason = 'empty_text' THEN 'none' ELSE 'unknown' END AS origin FROM d""")
def notices(t):
    """Notice and origin of segments by the decision tables."""
    k, used = F.col("doc_id"), F.col("doc_id") % 3 > 0
    pick = lambda *names: F.get(F.array(*[F.lit(x) for x in names]), (k % len(names)).cast("int"))
    mode = pick("", "sentence_range", "chunked_sentence_range", "local_fallback", "chunked_mixed_fallback")
    reason = pick("ok", "preprocessing_failed", "local_segmentation_fallback", "ai_segmentation_failed", "partial_ai_segmentation_failed", "empty_text", "other")
    return t.documents.select("doc_id", A.notice(used, F.array(reason)).alias("notice"), A.segmentation_source(mode, used, reason).alias("origin"))


@query("""WITH p AS (SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda x: length(x)) AS u, list_transform(string_split(next, ' '), lambda x: length(x)) AS a FROM (SELECT conv_id, turn, role, text, lead(text) OVER w AS next, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)) WHERE role = 'user' AND next_role = 'assistant'),
f AS (SELECT *, least(len(u) + len(a), 64) AS n, least(len(u), 64) AS pn FROM p), w AS (SELECT conv_id, CAST(ceil(max(n) / 8.0) * 8 AS BIGINT) AS width FROM f GROUP BY 1)
SELECT conv_id, turn, pn AS prompt_tokens, n - pn AS trained_tokens, len(u) + len(a) > 64 AS truncated, width, md5(array_to_string(list_concat(list_concat(list_transform(range(pn), lambda x: -100), a[1:n - pn]), list_transform(range(width - n), lambda x: -100)), ',')) AS labels_digest FROM f JOIN w USING (conv_id)""")
def assistant_masks(t):
    """Token labels that cover answers only, cut at 64 and padded to a multiple of 8 in each conversation; word lengths stand for ids."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    c = t.conversations.withColumns({"next": F.lead("text").over(w), "next_role": F.lead("role").over(w)}).where("role = 'user' and next_role = 'assistant'")
    ids = lambda name: F.transform(F.split(name, " "), lambda x: F.length(x))
    f = c.select("conv_id", "turn", A.assistant_features(ids("text"), ids("next"), 64).alias("f"))
    widths = f.groupBy("conv_id").agg(A.batch_width(F.max(F.size("f.input_ids"))).alias("width"))
    labels = A.padded(F.col("f.labels"), F.col("width"), -100)
    trained = F.size("f.input_ids") - F.col("f.prompt_tokens")
    return f.join(widths, "conv_id").select("conv_id", "turn", F.col("f.prompt_tokens").cast("long").alias("prompt_tokens"), trained.cast("long").alias("trained_tokens"), F.col("f.truncated").alias("truncated"), F.col("width").cast("long").alias("width"), F.md5(F.array_join(F.transform(labels, lambda x: x.cast("string")), ",")).alias("labels_digest"))


@query(_LABELS + """ SELECT doc_id, object AND NOT missing AND NOT extra AS exact_key_order, object AND told AS main_idea_string, object AND listed AS key_points_list, object AND listed AND np + CAST(odd AS INTEGER) = 4 AS exactly_4_key_points, object AND listed AND NOT odd AS all_key_points_strings,
 object AND told AND NOT list_contains(issues, 'main_idea_sentences') AS main_idea_two_sentences, object AND listed AND NOT odd AND NOT blank AND np = 4 AND NOT list_contains(issues, 'key_point_sentences') AS each_key_point_one_sentence, object AND ((told AND trim(idea) = '') OR (listed AND blank)) AS has_empty_string,
 object AND len(issues) - len(list_filter(issues, lambda x: x IN ('main_idea_sentences', 'key_point_sentences', 'key_point_empty'))) = 0 AS schema_pass FROM i""")
def output_flags(t):
    """Flags of generated output by its schema and sentence counts."""
    flags = G.output_flags(F.col("json"))
    names = ["exact_key_order", "main_idea_string", "key_points_list", "exactly_4_key_points", "all_key_points_strings", "main_idea_two_sentences", "each_key_point_one_sentence", "has_empty_string", "schema_pass"]
    return labels_json(t).select("doc_id", *[flags[n].alias(n) for n in names])


@query("""WITH s AS (SELECT doc_id, 'Bearer ' || split_part(text, ' ', 1) || '.x1 said ' || left(md5(text), 8) AS log, CASE doc_id % 3 WHEN 0 THEN '```json\n{"a": ' || doc_id || '}\n```' WHEN 1 THEN ' json: {"a": ' || doc_id || '} ' ELSE '{"a": ' || doc_id || '}' END AS made FROM documents)
SELECT doc_id, md5(regexp_replace(log, 'Bearer[ \\t\\n\\r\\f]+[A-Za-z0-9_.=-]+', 'Bearer <TOKEN>', 'g')) AS redacted, '{"a": ' || doc_id || '}' AS bare FROM s""")
def redacted_logs(t):
    """Log lines without tokens, and JSON without fences or labels."""
    k = F.col("doc_id").cast("string")
    body = F.concat(F.lit('{"a": '), k, F.lit("}"))
    made = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" json: "), body, F.lit(" "))).otherwise(body)
    log = F.concat(F.lit("Bearer "), F.split_part("text", F.lit(" "), F.lit(1)), F.lit(".x1 said "), F.left(F.md5("text"), F.lit(8)))
    return t.documents.select("doc_id", F.md5(X.redact(log)).alias("redacted"), X.strip_fence(made).alias("bare"))


@query("SELECT coalesce(s.setting, c.setting) AS setting, s.before, c.now FROM (SELECT lang AS setting, CAST(count(*) % 7 AS VARCHAR) AS before FROM documents GROUP BY 1) s FULL JOIN (VALUES ('en', '1'), ('de', '2'), ('xx', '3')) c(setting, now) ON s.setting = c.setting WHERE s.before IS DISTINCT FROM c.now")
def setting_drift(t):
    """Stored settings that differ from the current ones."""
    stored = t.documents.groupBy(F.col("lang").alias("setting")).agg((F.count("*") % 7).cast("string").alias("value"))
    return S.drift(stored, {"en": "1", "de": "2", "xx": "3"}).select("setting", "before", "now")
