"""Native sentences and segments against the rules written as loops."""

import random

from pyspark.sql import functions as F

from lectern.functions import paragraphs as P
from lectern.operators import cuts as C


def sentences(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    return [tuple(x) for x in df.select(P.marked_sentences(F.col("text")).alias("s")).first().s]


def test_marked_sentences(spark):
    text = "# Title\nIt came, e.g. Late. Dr. Who left at 3.5 p.m. Then\r\nit went on.\n\n2. Works Cited:\nAfter it all."
    got = sentences(spark, text)
    assert [x[0] for x in got] == ["# Title", "It came, e.g. Late.", "Dr. Who left at 3.5 p.m.", "Then it went on.", "2. Works Cited:", "After it all."]
    assert [x[2:] for x in got] == [(1, True, False), (0, False, False), (0, False, False), (0, False, False), (0, True, True), (0, False, True)]
    assert [x[1] for x in got][:3] == [1, 5, 8]
    assert [x[4] for x in sentences(spark, "See www.a.org now. [3] Cited. Plain one.")] == [True, True, False]
    assert sentences(spark, None) == [] and sentences(spark, " \n\n ") == []


def test_content_drops_references_and_repeats(spark):
    long = "This sentence has quite a lot more than only ten words in it."
    text = f"Short one. {long} Short one. {long.upper()[0]}{long[1:]} http://x.y is here.\n\nBibliography\n\nGone."
    df = spark.createDataFrame([(text,)], "text string").select(P.content_sentences(P.marked_sentences(F.col("text"))).alias("s"))
    assert [(x["id"], x["text"]) for x in df.first().s] == [(1, "Short one."), (2, long), (3, "Short one.")]


def test_running_sums(spark):
    n = [0, 1, 255, 256, 257, 1000]
    df = spark.createDataFrame([(list(range(k)),) for k in n], "v array<int>").select("v", P.running_sums(F.col("v")).alias("p"))
    for r in df.collect():
        assert r.p == [sum(r.v[: i + 1]) for i in range(len(r.v))]


def loop_cuts(words, bounds, least, most, target):
    """bounds: place -> (strength, heading). The rules as a loop over sentences."""
    out, start, n = [], 0, len(words)
    while start < n:
        cum, run = [], 0
        for w in words[start:]:
            run += w
            cum.append(run)
        if cum[-1] < least:
            out.append(n - 1)
            break
        top = cum[-1] if cum[0] > most else most
        cs = [(start + i, c, *bounds[start + i]) for i, c in enumerate(cum) if start + i in bounds and c <= top]
        late, early = [c for c in cs if c[1] >= least], [c for c in cs if c[3] and min(180, least) <= c[1] < least]
        pool = late or early
        if pool:
            strongest = max(c[2] for c in pool)
            end = min(pool, key=lambda c: (0 if strongest - c[2] <= 0.05 else strongest - c[2], abs(c[1] - target), -c[2], c[0]))[0]
        else:
            end = min(range(start, n), key=lambda i: (abs(cum[i - start] - target), i))
        out.append(end)
        start = end + 1
    return out


def test_greedy_cuts_match_loop(spark):
    r = random.Random(4)
    rows = []
    for k in range(80):
        words = [r.choice([0, 3, 8, 15, 30, 30, 120] + [1000] * (k % 4 == 0)) for _ in range(r.randrange(1, 120))]
        bounds = {i: (1.5, True) if r.random() < 0.1 else (round(r.random(), 6), False) for i in range(len(words) - 1) if r.random() < 0.35}
        p = [sum(words[: i + 1]) for i in range(len(words))]
        rows.append((k, p, [(i, float(s), h, p[i]) for i, (s, h) in sorted(bounds.items())], loop_cuts(words, bounds, 450, 850, 650)))
    df = spark.createDataFrame(rows, "k int, p array<bigint>, b array<struct<i:int,strength:double,hard:boolean,words:bigint>>, want array<int>")
    got = df.withColumn("got", C._greedy(450, 850, 650)).collect()
    assert [x.got for x in got] == [x.want for x in got]


def test_segments_of_awkward_texts(spark):
    part = " ".join(f"Sentence number {i} speaks of topic {i // 40} in plain words." for i in range(200))
    rows = [(1, None), (2, ""), (3, "One."), (4, part), (4, part), (None, part), (5, "word " * 3000), (6, "## A\n" + part[:3000] + "\n## B\n" + part[3000:9000] + "\n## C\nend")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = C.segments(df).collect()
    by = {}
    for x in got:
        by.setdefault(x.doc_id, []).append(x)
    assert set(by) == {3, 4, None, 5, 6} and len(by[4]) == 2 * len(by[None]) and len(by[3]) == len(by[5]) == 1
    for x in (by[None], by[6]):
        x.sort(key=lambda s: s.segment_id)
        assert [s.segment_id for s in x] == list(range(1, len(x) + 1))
        assert all(a.last_sentence < b.first_sentence for a, b in zip(x, x[1:], strict=False))
    assert sum(s.word_count for s in by[None]) == len(part.split())
    assert C.segments(df.where("false")).collect() == []
