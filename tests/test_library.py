"""Sources, sinks, sentences, segments, streaming, sequences over small hand-made rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F


def test_records_and_errors(spark, tmp_path):
    from lectern.sources import readers as R

    lines = ['{"messages":[{"role":"system","content":"s"},{"role":"user","content":"hello"}]}', "", "not json", '{"messages":[{"role":"assistant","content":"x"}]}']
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    good, bad = R.read_records(spark, str(tmp_path), "slug")
    r = good.collect()[0]
    assert r.source_text == "hello" and r.record_id == "slug:" + r.source_sha256[:12] and good.count() == 1 and bad.count() == 2
    with pytest.raises(Exception, match="(?i)malformed"):
        R.read_strict(spark, str(tmp_path), "messages array<string>").collect()
    assert R.read_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0
    m = R.manifest(spark, str(tmp_path)).collect()[0]
    assert m.bytes == len("\n".join(lines)) and m.lines == 3


def test_other_sources(spark, tmp_path):
    from lectern.sources import readers as R

    (tmp_path / "ids").write_text("a # first\n\n#c\nb\na\n")
    assert {r.id: r.n for r in R.read_ids(spark, str(tmp_path / "ids")).collect()} == {"a": 2, "b": 1}
    body = "word " * 300
    (tmp_path / "t.xml").write_text(f'<all><health-topic id="1" title="T" url="u" language="English"><full-summary>&lt;p&gt;{body}&lt;/p&gt;</full-summary></health-topic><health-topic id="2" language="Spanish"><full-summary>{body}</full-summary></health-topic></all>')
    assert [(r.id, r.words) for r in R.read_topics(spark, str(tmp_path / "t.xml")).collect()] == [("1", 300)]
    (tmp_path / "c.csv").write_text("a,b\n1,\n,x\n")
    c = R.read_table(spark, str(tmp_path / "c.csv"))
    assert [r.v for r in c.select(R.first_filled("a", "b").alias("v")).collect()] == ["1", "x"]
    R.write_fan_out(c.withColumn("status", F.lit("ok")), str(tmp_path / "out"), "status")
    assert spark.read.json(str(tmp_path / "out" / "status=ok")).count() == 2
    assert R.same_rows(c, c) and not R.same_rows(c, c.limit(1))
    up = spark.createDataFrame([("a.TXT", "aGVsbG8="), ("b.pdf", "aGVsbG8=")], "name string, content string")
    assert [(r.text, r.notice) for r in R.decode_uploads(up, "name", "content", 4).collect()] == [("hell", "truncated"), (None, "unsupported")]


def test_scan_sentences():
    from lectern.functions.sentences import scan_sentences as s

    assert s("Dr. Smith paid 3.5 dollars. He left!") == ["Dr. Smith paid 3.5 dollars.", "He left!"]
    assert s("See e.g. a case. The U.S. agency said so. In the U.S. It rained.") == ["See e.g. a case.", "The U.S. agency said so.", "In the U.S.", "It rained."]
    assert s("Visit a.com now. No mark at end") == ["Visit a.com now.", "No mark at end"] and s(None) == s(" ") == []


def test_segments_cover_every_sentence_once(spark, sf_dir):
    from lectern.operators import cuts, segments as G

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {}
    for r in G.segment_documents(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    for d in cuts.segment_cuts(docs).collect():
        s = sorted(got.pop(d.doc_id, []), key=lambda r: r.segment_id)
        assert [r.segment_id for r in s] == list(range(1, len(s) + 1)) and all(a.last_sentence < b.first_sentence for a, b in zip(s, s[1:], strict=False))
        assert " ".join(r.content for r in s) == " ".join(x["text"] for x in d.s) and sum(r.word_count for r in s) == sum(x["words"] for x in d.s)
        assert all(set(r.summary.split()) <= set(r.content.split()) for r in s)
    assert not got and G.segment_documents(spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")).collect() == []


def test_streams_match_batch(spark, sf_dir, tmp_path):
    from lectern.operators import state
    from lectern.streaming import attempts as A
    from pyspark.sql.window import Window

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("windows", A.windowed_counts(stream), "complete"), ("ends", A.outcomes(stream, "user_id", "purchase", "error"), "update")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    batch = A.windowed_counts(events)
    assert {(r.start, r.event_type, r.n) for r in spark.table("windows").collect()} == {(r.start, r.event_type, r.n) for r in batch.collect()}
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    want = state.outcomes(events.withColumn("n", n), "user_id", "n", F.col("event_type") == "purchase", F.col("event_type") == "error", 4)
    assert {(r.user_id, r.status) for r in spark.table("ends").collect()} == {(r.user_id, r.status) for r in want.collect()}


def test_numbers_without_a_single_task(spark):
    from lectern.operators.sequences import number_rows

    d = spark.range(1_000).selectExpr("id", "id % 3 as g")
    assert [r.number for r in number_rows(d, ["id"]).orderBy("id").collect()] == list(range(1_000))
    assert {(r.id, r.number) for r in number_rows(d, ["id"], ["g"]).collect()} == {(i, i // 3) for i in range(1_000)}


def test_numbers_of_rows_that_are_read_twice(spark):
    from lectern.operators.sequences import adjacent_pairs, number_rows

    d = spark.range(10_000).selectExpr("(id * 7919) % 10000 as id", "transform(sequence(1, 64), i -> double(xxhash64(id, i))) as v", "if(id % 5 = 0, null, 'x') as g")
    assert adjacent_pairs(d, "id", "v").where("next_id = id + 1").count() == 9_999
    n = number_rows(d, ["id"], ["g"]).select("g", "number", F.hash("v"))
    assert n.groupBy("g").agg(F.count("*"), F.countDistinct("number"), F.max("number")).orderBy("g").collect() == [(None, 2_000, 2_000, 1_999), ("x", 8_000, 8_000, 7_999)]


def test_equal_titles_keep_their_class(spark):
    from lectern.operators import reconcile as R

    d = spark.createDataFrame([(1, "red green blue grey"), (2, "Grey blue, green red"), (3, "the red green"), (4, "red green blue grey pink"), (5, "pink grey red green blue")], "k long, t string")
    assert {(r.k, r.representative) for r in R.title_classes(d, "k", "t", ["the"]).collect()} == {(1, 1), (2, 1), (4, 4), (5, 4)}
    assert {(r.x, r.y) for r in R.near_title_pairs(d, "k", "t", ["the"]).collect()} == {(1, 4)}


def test_excerpt_issues_count_as_sql_does(spark):
    from lectern.functions import predicates as P

    texts = ["a. b. c. d. a. b. x", "a. x b. x c. x d. x a. x b. x", "a12345b A1 a12345_ (a12345", "a12345 a12346 a12345 a12347 b"]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string")
    got = d.orderBy("i").select(P.is_exercise_page(F.col("t")), P.has_excerpt_issue(F.col("t"))).collect()
    assert [r[:] for r in got] == [(False, False), (True, False), (False, True), (False, False)]


def test_near_titles_and_adjacent_documents_match_loops(spark):
    import math
    import random
    from collections import Counter

    from lectern.operators import reconcile as R

    r = random.Random(3)
    rows = [(i, "xy"[i % 2], " ".join(r.choice("abcdefghijklmnop") * 3 for _ in range(r.randint(0, 14)))) for i in range(150)]
    df = spark.createDataFrame(rows, "k long, s string, t string")
    sets = {}
    for k, _, t in rows:
        if len(set(t.split())) >= 3:
            sets.setdefault(frozenset(t.split()), k)
    for least in (0.5, 0.8):
        want = {(k, m): round(len(a & b) / len(a | b), 9) for a, k in sets.items() for b, m in sets.items() if k < m and len(a & b) >= 3 and len(a & b) / len(a | b) >= least}
        assert want and {(x.x, x.y): x.similarity for x in R.near_title_pairs(df, "k", "t", [], least).collect()} == want
    want = {}
    for s in "xy":
        docs = [(k, t.split()) for k, g, t in rows if g == s]
        seen = Counter(w for _, t in docs for w in set(t))
        v = [{w: n / len(t) * (math.log((1 + len(docs)) / (1 + seen[w])) + 1) for w, n in Counter(t).items()} for _, t in docs]
        for i in range(len(docs) - 1):
            norm = math.sqrt(sum(x * x for x in v[i].values()) * sum(x * x for x in v[i + 1].values()))
            want[s, docs[i][0], docs[i + 1][0]] = sum(x * v[i + 1].get(w, 0) for w, x in v[i].items()) / norm if norm else 0.0
    got = {(x.s, x.k, x.next_id): x.similarity for x in R.tfidf_adjacent(df.withColumnRenamed("t", "text"), "s", "k").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_drift_and_gates(spark):
    from lectern.operators import gates, state

    stored = spark.createDataFrame([("model", "a"), ("hash", "1")], "setting string, value string")
    assert {r.setting for r in state.drift(stored, {"model": "b", "new": "x", "hash": "1"}).collect()} == {"model", "new"}
    rows = [('{"main_idea":"i. j.","key_points":["a","b","c","d"]}',), ('{"main_idea":"i. j.","key_points":["a","b","c","d","e"]}',), ('{"key_points":[],"main_idea":""}',), ("no",), (None,), ('{"main_idea":5,"key_points":[1,true,"c","d"]}',), ('{"main_idea":"Dr. A. sat. He ran!","key_points":["a  b","b","c?","d. e."]}',)]
    d = spark.createDataFrame(rows, "j string")
    j = F.col("j")
    got = [(r.g.action, r.i, r.c) for r in d.select(gates.guard(j).alias("g"), gates.label_issues(j).alias("i"), gates.canonical_label(j).alias("c")).collect()]
    assert got[0] == ("pass", [], '{"main_idea":"i. j.","key_points":["a.","b.","c.","d."]}') and got[1][:2] == ("truncated", ["key_points_count"])
    assert got[2][0] == "error" and got[3] == got[4] == ("error", ["not_object"], None)
    assert got[5][:2] == ("error", ["main_idea_not_string", "key_point_not_string"]) and got[6][1] == ["main_idea_sentences", "key_point_sentences"]


def test_sentences_are_the_same_in_both_engines(spark):
    from lectern.functions.sentences import scan_sentences, sentence_units, split_simply

    texts = ["He paid 3.5 dollars. Dr. Smith left at 5 p.m. and slept. See a.com.", "The U.S. Army won. In the U.S. People ran, etc. and so on. Foods, etc. Then more", "Visit www.x.org. fig. 3 shows it. Is it? Yes", None, "", " tail"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.u for r in d.select(sentence_units("t").alias("u")).collect()]
    assert got == [scan_sentences(t) for t in texts]
    assert got[0] == ["He paid 3.5 dollars.", "Dr. Smith left at 5 p.m. and slept.", "See a.com."] and got[1][-2:] == ["Foods, etc.", "Then more"]
    one = spark.createDataFrame([("A b. C!\nd\u3002e",)], "t string").select(split_simply(F.col("t")).alias("u")).first().u
    assert one == ["A b.", "C!", "d\u3002", "e"]


def test_term_stats_count_a_shared_id_once_and_none_for_null(spark):
    from lectern.operators.metrics import term_stats

    rows = [(1, "en", "red red blue"), (1, "en", "red"), (2, "en", "Blue"), (None, "en", "red green"), (1, "fr", "red"), (3, None, "red"), (4, "en", None)]
    for some in (rows, [r for r in rows if r != (1, "en", "red")]):
        got = {(r[0], r[1]): (r.tf, r.df, r.idf) for r in term_stats(spark.createDataFrame(some, "doc_id long, lang string, text string"), "lang", least=0).collect()}
        n = sum(r[1] == "en" for r in some)
        assert set(got) == {("en", "red"), ("en", "blue"), ("en", "green"), ("fr", "red")}
        assert got["en", "red"][:2] == (len(some) - 3, 1) and got["en", "blue"][:2] == (2, 2) and got["en", "green"] == (1, 0, round(float(np.log(1 + n)) + 1, 9))
