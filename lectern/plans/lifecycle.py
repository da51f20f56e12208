"""Queries over records' lives: messages, gates, attempts, JSON, event windows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.paragraphs import bound
from lectern.operators import gates as G
from lectern.operators import state as S
from lectern.operators.cuts import computed
from lectern.plans.registry import query

_ROLES = "WITH m AS (SELECT conv_id, list(role ORDER BY turn, role, text) AS roles, count(*) AS n, bool_or(trim(text) = '') AS blank FROM conversations GROUP BY conv_id)"


@query(_ROLES + " SELECT conv_id, array_to_string(list_filter([CASE WHEN n <> 3 THEN 'count' END, CASE WHEN roles <> ['system', 'user', 'assistant'] THEN 'order' END, CASE WHEN blank THEN 'blank' END], lambda x: x IS NOT NULL), ',') AS issues FROM m")
def role_order_violations(t):
    """What is wrong with the order of roles of each conversation."""
    return G.messages_of(t.conversations).select("conv_id", F.array_join(G.role_violations(F.col("messages")), ",").alias("issues"))


@query("""WITH m AS (SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn, role, text) AS m FROM conversations GROUP BY conv_id)
SELECT conv_id, md5(array_to_string(list_transform(m, lambda x, i: x.role || ':' || CASE WHEN i = 1 THEN 'PROMPT' ELSE x.content END), '|')) AS digest, true AS rest_same, md5(list_filter(m, lambda x: x.role = 'user')[1].content) AS first_user FROM m""")
def message_rebuild(t):
    """Messages with the first content replaced, proved equal otherwise, and the first user text."""
    m = G.messages_of(t.conversations).withColumn("new", G.replace_first(F.col("messages"), F.lit("PROMPT")))
    flat = F.array_join(F.transform("new", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|")
    return m.select("conv_id", F.md5(flat).alias("digest"), G.same_but_first(F.col("messages"), F.col("new")).alias("rest_same"), F.md5(G.first_of_role(F.col("messages"), "user")).alias("first_user"))


@query("SELECT conv_id, turn, md5(text) AS user_digest, md5(next) AS assistant_digest FROM (SELECT conv_id, turn, role, text, lead(text) OVER w AS next, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)) WHERE role = 'user' AND next_role = 'assistant'")
def message_pairs(t):
    """User turns with the assistant's answer that follows."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    c = t.conversations.withColumns({"next": F.lead("text").over(w), "next_role": F.lead("role").over(w)})
    return c.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.md5("text").alias("user_digest"), F.md5("next").alias("assistant_digest"))


@query("SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'pass' WHEN toxic = 1 THEN 'fail' ELSE 'retry' END AS verdict, array_to_string(list_filter([CASE WHEN quality = 0 THEN 'low_quality' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN quality NOT IN (0, 1) OR quality IS NULL THEN 'bad_type' END], lambda x: x IS NOT NULL), ',') AS issues FROM labels")
def judge_gate(t):
    """Verdict and issues of judged rows."""
    q, x = F.col("quality"), F.col("toxic")
    verdict = F.when((q == 1) & (x == 0), "pass").when(x == 1, "fail").otherwise("retry")
    found = G.issues({"low_quality": q == 0, "toxic": x == 1, "bad_type": ~q.isin(0, 1) | q.isNull()})
    return t.labels.select("doc_id", verdict.alias("verdict"), F.array_join(found, ",").alias("issues"))


# labels made of documents' words: doc_id says how many sentences and points there are and what is wrong
_LABELS = """WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents),
s AS (SELECT doc_id, list_transform(range(0, 20), lambda k: array_to_string(list_slice(w, 3 * k + 1, 3 * k + 3), ' ') || '.') AS s FROM t),
j AS (SELECT doc_id, array_to_string(list_slice(s, 1, 1 + doc_id % 3), ' ') AS idea, 1 + doc_id % 6 AS np, doc_id % 11 = 4 AS odd, doc_id % 9 = 8 AS blank, doc_id % 19 <> 7 AS object, doc_id % 7 <> 3 AS told, doc_id % 13 <> 5 AND doc_id % 23 <> 9 AS listed, doc_id % 23 = 9 AS missing, doc_id % 17 = 6 AS extra,
  list_transform(range(1, 2 + doc_id % 6), lambda k: CASE WHEN k = 1 AND doc_id % 9 = 8 THEN '' WHEN k = 2 AND doc_id % 5 = 0 THEN s[k + 4] || ' ' || s[k + 10] ELSE s[k + 4] END) AS p FROM s),
i AS (SELECT *, CASE WHEN NOT object THEN ['not_object'] ELSE list_filter([CASE WHEN missing THEN 'missing_keys' END, CASE WHEN extra THEN 'extra_keys' END, CASE WHEN NOT told THEN 'main_idea_not_string' END, CASE WHEN NOT listed THEN 'key_points_not_array' END,
  CASE WHEN told AND len(regexp_extract_all(idea, '[.!?]+(?: |$)')) <> 2 THEN 'main_idea_sentences' END, CASE WHEN listed AND np + CAST(odd AS INTEGER) <> 4 THEN 'key_points_count' END, CASE WHEN listed AND odd THEN 'key_point_not_string' END, CASE WHEN listed AND blank THEN 'key_point_empty' END,
  CASE WHEN listed AND len(list_filter(p, lambda x: x <> '' AND len(regexp_extract_all(x, '[.!?]+(?: |$)')) <> 1)) > 0 THEN 'key_point_sentences' END], lambda x: x IS NOT NULL) END AS issues FROM j)"""


def labels_json(t):
    """Labels made of documents' words, of which some lack keys or have values of other types."""
    d, k = t.documents, F.col("doc_id")
    words = F.slice(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)), 1, 60)
    parts = bound(words, lambda w: F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.concat(F.array_join(F.slice(w, 3 * i + 1, F.lit(3)), " "), F.lit("."))))
    d = computed(d, s=parts).select("doc_id", "s")
    idea = F.array_join(F.slice("s", F.lit(1), (1 + k % 3).cast("int")), " ")
    at = lambda i: F.get(F.col("s"), i.cast("int"))
    point = lambda i: F.when((i == 1) & (k % 9 == 8), "").when((i == 2) & (k % 5 == 0), F.concat(at(i + 3), F.lit(" "), at(i + 9))).otherwise(at(i + 3))
    points = F.to_json(F.transform(F.sequence(F.lit(1).cast("long"), 1 + k % 6), point))
    points = F.when(k % 11 == 4, F.concat(F.lit("[true,"), F.substr(points, F.lit(2)))).otherwise(points)
    points = F.when(k % 13 == 5, '{"1":"a"}').otherwise(points)
    main = F.when(k % 7 == 3, "5").otherwise(F.concat(F.lit('"'), idea, F.lit('"')))
    body = F.concat(F.lit('{"main_idea":'), main, F.when(k % 23 == 9, "").otherwise(F.concat(F.lit(',"key_points":'), points)), F.when(k % 17 == 6, ',"more":null').otherwise(""), F.lit("}"))
    return computed(d, json=F.when(k % 19 == 7, F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)).select("doc_id", "json")


@query(_LABELS + """ SELECT doc_id, array_to_string(issues, ',') AS issues, CASE WHEN object AND NOT missing AND NOT extra AND told AND listed AND NOT odd AND NOT blank AND np >= 4 THEN CASE WHEN np > 4 THEN 'truncated' ELSE 'pass' END ELSE 'error' END AS action,
 CASE WHEN len(issues) = 0 THEN md5('{"main_idea":"' || idea || '","key_points":["' || array_to_string(p, '","') || '"]}') END AS canonical FROM i""")
def structural_gate(t):
    """Issues of labels' JSON by types and sentence counts, what the output guard does with them, and the canonical label of those without."""
    j = labels_json(t)
    c = F.col("json")
    return j.select("doc_id", F.array_join(G.label_issues(c), ",").alias("issues"), G.guard(c)["action"].alias("action"), F.md5(G.canonical_label(c)).alias("canonical"))


@query("SELECT conv_id, count(*) AS n, CASE WHEN count(*) > 6 THEN 'too_many' WHEN count(DISTINCT turn) < count(*) THEN 'duplicate_ids' WHEN min(length(trim(text))) = 0 THEN 'empty' WHEN max(length(text)) > 4000 THEN 'too_large' ELSE 'ok' END AS status FROM conversations GROUP BY conv_id")
def request_status(t):
    """Checks of requests: number, unique ids, sizes."""
    return G.request_checks(t.conversations, "conv_id", "turn", "text", 6, 4000)


@query("""SELECT doc_id, CASE WHEN n_chars < 200 THEN 'short' WHEN contains(text, '$$$') THEN 'symbols' WHEN contains(text, '!!') THEN 'shouting' WHEN regexp_matches(text, 'https?://') THEN 'link' WHEN len(regexp_extract_all(text, '[?]')) > 5 THEN 'questions' END AS reason FROM documents""")
def reject_cascade(t):
    """The first reason to reject each document."""
    c = F.col("text")
    checks = {"short": F.col("n_chars") < 200, "symbols": F.contains(c, F.lit("$$$")), "shouting": F.contains(c, F.lit("!!")), "link": c.rlike("https?://"), "questions": F.regexp_count(c, F.lit("[?]")) > 5}
    return t.documents.select("doc_id", G.first_reason(checks).alias("reason"))


_ATTEMPTS = "WITH a AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"


@query(_ATTEMPTS + """, e AS (SELECT user_id, min(n) FILTER (WHERE n <= 4 AND event_type IN ('purchase', 'error')) AS hit, max(n) AS top FROM a GROUP BY user_id)
SELECT e.user_id, coalesce(CASE WHEN a.event_type = 'purchase' THEN 'accepted' WHEN a.event_type = 'error' THEN 'failed' END, CASE WHEN top >= 4 THEN 'exhausted' ELSE 'pending' END) AS status, CAST(coalesce(hit, least(top, 4)) AS INTEGER) AS attempts_used FROM e LEFT JOIN a ON a.user_id = e.user_id AND a.n = e.hit""")
def attempt_outcome(t):
    """Outcome of each record over its attempts, with a budget of four."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    a = t.events.withColumn("n", n)
    return S.outcomes(a, "user_id", "n", F.col("event_type") == "purchase", F.col("event_type") == "error", 4)


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_status(t):
    """The last event of each record."""
    return S.latest(t.events, "user_id", ["ts", "event_id"], ["event_id", "event_type"])


@query("SELECT 'all' AS level, event_type AS a, NULL AS b, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'user', event_type, CAST(user_id AS VARCHAR), count(*) FROM events GROUP BY event_type, user_id")
def status_summary(t):
    """Counts by status, and by record and status, in one pass."""
    g = t.events.groupingSets([["event_type"], ["event_type", "user_id"]], "event_type", "user_id").agg(F.count("*").alias("n"), F.grouping("user_id").alias("g"))
    return g.select(F.when(F.col("g") == 1, "all").otherwise("user").alias("level"), F.col("event_type").alias("a"), F.col("user_id").cast("string").alias("b"), "n")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def resume_todo(t):
    """Documents not yet done."""
    return S.resume(t.documents.select("doc_id"), t.labels.where("quality = 1"), "doc_id")


@query("SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, array_to_string(json_keys(props), ',') AS keys FROM events")
def json_fields(t):
    """First field and keys of a JSON column."""
    keys = F.json_object_keys("props")
    m = F.from_json("props", "map<string,string>")
    return t.events.select("event_id", F.element_at(m, keys[0]).alias("first_value"), F.array_join(keys, ",").alias("keys"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def hourly_windows(t):
    """Tumbling windows of an hour."""
    g = t.events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM s)
SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, session""")
def sessions(t):
    """Sessions with gaps under half an hour."""
    g = t.events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("start"))
    return g.select("user_id", "start", "n")


@query("SELECT doc_id, 'mock:' || sha256(text)[1:12] AS summary, CASE WHEN contains(text, '###') THEN 'error' ELSE 'ok' END AS status FROM documents")
def mock_runtime(t):
    """Deterministic stand-in for a summariser."""
    c = F.col("text")
    return t.documents.select("doc_id", F.concat(F.lit("mock:"), F.left(F.sha2(c, 256), F.lit(12))).alias("summary"), F.when(F.contains(c, F.lit("###")), "error").otherwise("ok").alias("status"))
