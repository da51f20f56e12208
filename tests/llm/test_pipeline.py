"""The pipeline's stages by their promises, and the registered queries against brute force."""

import os

import pytest


def test_stages(spark, sf_dir):
    import corpus_pipeline as c
    from lectern.llm.common import spill

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, None
    seen = {}
    for name, stage in c.STAGES:
        before = docs
        docs = spill(stage(spark, docs, sf_dir))
        seen[name] = docs
        if name != "encoding":
            assert docs.columns == columns and docs.count() <= before.count()
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    assert ids(seen["mixing"]) == ids(seen["passage_dedup"]) == ids(seen["near_dedup"]) == ids(seen["encoding"])
    assert ids(seen["near_dedup"]) < ids(seen["quality"])
    from lectern.llm.minhash import near_duplicates
    from lectern.llm.passages import repeated_passages

    assert near_duplicates(seen["near_dedup"]).where("not kept").count() == 0
    left = repeated_passages(seen["passage_dedup"]).count()
    assert left <= 0.1 * repeated_passages(seen["near_dedup"]).count()
    assert c.run(spark, sf_dir).count() == seen["encoding"].count()


def test_encoding_decodes_again(spark, sf_dir):
    import hashlib

    import corpus_pipeline as c
    from tests.llm import edge

    docs = edge.documents(spark, [(1, "Plain text, 12 words", "en", "s"), (2, "na\u00efve \u4f60\u597d\n", "en", "s")], extra=False)
    want = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in docs.collect()}
    assert {r.doc_id: r.decoded_sha256 for r in c.encoding(spark, docs, sf_dir).collect()} == want


def test_stages_take_empty_and_awkward_documents(spark, tmp_path):
    import corpus_pipeline as c
    from tests.llm import edge

    edge.labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    for rows in ([], None):
        docs = edge.documents(spark, rows, extra=False)
        for name, stage in c.STAGES:
            out = stage(spark, docs, str(tmp_path))
            n = out.count()
            assert rows is None or n == 0
            if name != "encoding":
                docs = out


@pytest.mark.parametrize("name", ["op1_licenses", "op2_lattice", "op3_pfair", "op4_minhash", "op7_topk", "op8_revisits"])
def test_queries_match_sql(spark, sf_dir, name):
    import duckdb

    from lectern.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    want = con.sql(ORACLE_SQL[name])
    columns = sorted(want.columns)
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == columns
    rows = sorted(tuple(str(r[c]) for c in columns) for r in got.collect())
    at = [list(want.columns).index(c) for c in columns]
    assert rows == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())


def test_minhash_query_matches_brute_force(spark, sf_dir):
    from lectern.llm.queries import QUERIES
    from tests.llm.test_text_operators import brute_components, shingle_sets

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    sets = shingle_sets([(r.doc_id, r.text) for r in docs], 3)
    want = brute_components(sets, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op4_minhash"](spark, sf_dir).collect()} == {i: (len(s), want[i]) for i, s in sets.items()}


def test_passage_query_finds_every_verbatim_run(spark, sf_dir):
    """Documents that share 50 words in a row with an earlier one are all found; what else is found is similar."""
    import re

    from lectern.llm.queries import QUERIES

    words = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", r.text.lower()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    seen, want = set(), set()
    for i in sorted(words):
        runs = {tuple(words[i][a : a + 50]) for a in range(len(words[i]) - 49)}
        if runs & seen:
            want.add(i)
        seen |= runs
    rows = QUERIES["op9_passages"](spark, sf_dir).collect()
    assert want <= {r.doc_id for r in rows}
    for r in rows:
        a, b = words[r.doc_id][r.start_word : r.start_word + r.n_words], words[r.source_doc_id][r.source_start_word :]
        x = {tuple(a[i : i + 5]) for i in range(len(a) - 4)}
        y = {tuple(b[i : i + 5]) for i in range(int(len(a) * 1.3) - 4)}
        assert r.source_doc_id < r.doc_id and r.n_words >= 48 and len(x & y) >= 0.8 * len(x)


def test_encoding_query_matches_tiktoken(spark, sf_dir):
    import hashlib

    import public_tokenizers
    import tiktoken

    from lectern.llm.bpe import load_ranks
    from lectern.llm.queries import QUERIES

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op6_bpe"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_classifiers_on_held_out_labels(spark, monkeypatch):
    """On labels that taught nothing: few errors, and scores near the share of label 1 among those that have them."""
    from pyspark.sql import functions as F

    from lectern.llm import quality
    from lectern.llm.queries import QUERIES

    sf = "/root/testdata/sf0.1"
    y = spark.read.parquet(f"{sf}/labels.parquet")
    t = QUERIES["op10_toxicity"](spark, sf).where("held_out").join(y, "doc_id").select("score", "predicted", "toxic").collect()
    toxic, clean = [r for r in t if r.toxic == 1], [r for r in t if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic) and sum(r.predicted for r in clean) <= 0.01 * len(clean)
    for lo, hi in ((0, 0.1), (0.1, 0.9), (0.9, 1.01)):
        part = [r for r in t if lo <= r.score < hi]
        if len(part) >= 20:
            assert abs(sum(r.score for r in part) - sum(r.toxic for r in part)) <= 0.15 * len(part)
    monkeypatch.setattr(quality, "SAMPLE", 1_000)  # the other labels taught nothing
    taught = y.where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("q")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(1_000)
    q = QUERIES["op5_quality"](spark, sf).join(y.withColumnRenamed("quality", "label"), "doc_id").join(taught, "doc_id", "left_anti").groupBy("label").agg(F.avg(F.col("accepted").cast("int")).alias("rate"), F.count("*").alias("n"))
    rates = {r.label: r for r in q.collect()}
    assert rates[1].rate >= 0.98 and rates[0].rate <= 0.08 and rates[1].n > 1_000


def test_quality_query_matches_brute_force(spark, sf_dir):
    """Rates, prior weights and quality from the query's own logits, by plain Python."""
    import math
    from collections import defaultdict

    from lectern.llm.quality import LEAST_STRENGTH, MOST_STRENGTH, PATH_WEIGHT
    from lectern.llm.queries import QUERIES

    rows = QUERIES["op5_quality"](spark, sf_dir).collect()
    docs = {r.doc_id: (r.source, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(docs) and all(docs[r.doc_id] == (r.host, r.path) for r in rows)
    hosts, sites = defaultdict(list), defaultdict(list)
    for r in rows:
        p = 1 / (1 + math.exp(-r.logit))
        hosts[r.host].append(p)
        sites[r.host, r.path].append(p)
    everything = [p for v in hosts.values() for p in v]
    g = sum(everything) / len(everything)

    def strength(groups, parent):
        of = defaultdict(list)
        for k, v in groups.items():
            of[parent(k)].append(v)
        n, k = len(everything), len(groups)
        within = sum(sum((p - sum(v) / len(v)) ** 2 for p in v) for v in groups.values()) / (n - k) if n > k else 0.0
        between = c = free = 0.0
        for vs in of.values():
            m = sum(map(len, vs))
            mean = sum(map(sum, vs)) / m
            between += sum(len(v) * (sum(v) / len(v) - mean) ** 2 for v in vs)
            c += m - sum(len(v) ** 2 for v in vs) / m
            free += len(vs) - 1
        between = (between - free * within) / c if free else 0.0
        return min(MOST_STRENGTH, max(LEAST_STRENGTH, g * (1 - g) / between - 1)) if between > 1e-12 else MOST_STRENGTH

    a, b = strength(hosts, lambda h: 0), strength(sites, lambda s: s[0])
    odds = lambda p: math.log(p / (1 - p))
    for r in rows:
        host = (sum(hosts[r.host]) + a * g) / (len(hosts[r.host]) + a)
        s = sites[r.host, r.path]
        path = (sum(s) + b * host) / (len(s) + b)
        want = 1 / (1 + math.exp(-(r.logit + PATH_WEIGHT * (odds(path) - odds(g)))))
        assert max(abs(r.host_rate - host), abs(r.path_rate - path), abs(r.quality - want)) < 1e-6 and r.accepted == (r.quality >= 0.5)
