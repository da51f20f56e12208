"""Vectors, top-k, components and web captures over awkward tables and brute force."""

import gzip
import math

import numpy as np
import pytest


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 0, 0, 0) for r in rows], "vec_id long, embedding array<float>, label int, rep int, n int, t int")


AWKWARD = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (4, [0.0, 0.0], 1), (5, None, 1), (6, [float("nan"), 1.0], 1), (7, [None, 1.0], 1), (8, [float("inf"), 1.0], 1), (9, [1.0, 0.0], None), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1.0, 0.0], 2), (None, [1.0, 0.0], 1), (2, [1.0, 0.0], 1)]


def test_lattice_awkward(spark):
    from lectern.llm.lattice import near_duplicate_vectors

    got = {r.vec_id: r for r in near_duplicate_vectors(vectors(spark, AWKWARD)).collect()}
    assert set(got) == set(range(1, 13))
    assert all(got[i].component_id == 1 and got[i].n_links == 2 for i in (1, 2, 3))
    assert all(got[i].n_links == 0 and got[i].kept for i in range(4, 13))
    assert near_duplicate_vectors(vectors(spark, [])).collect() == []


@pytest.mark.parametrize("block", [1024, 16])
def test_lattice_matches_brute_force(spark, block, monkeypatch):
    from lectern.llm import lattice

    monkeypatch.setattr(lattice, "BLOCK", block)
    rng = np.random.default_rng(5)
    base = rng.standard_normal((30, 64))
    x = np.concatenate([base, base[:10].repeat(8, 0) + 0.12 * rng.standard_normal((80, 64)), base[:1] + 0.02 * rng.standard_normal((60, 64))]).astype(np.float32)
    label = [int(i % 30 % 3) for i in range(30)] + [int(i // 8 % 3) for i in range(80)] + [0] * 60
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice.near_duplicate_vectors(vectors(spark, [(i, v.tolist(), y) for i, (v, y) in enumerate(zip(x, label, strict=True))])).collect()}
    u = x.astype(float)
    u /= np.sqrt((u * u).sum(1))[:, None]
    link = (u @ u.T >= 0.93) & (np.array(label)[:, None] == np.array(label)[None])
    np.fill_diagonal(link, False)
    assert {i: n for i, (n, _) in got.items()} == dict(enumerate(link.sum(1).tolist()))
    comp = list(range(len(x)))
    for _ in comp:
        comp = [min([comp[i], *(comp[j] for j in np.flatnonzero(link[i]))]) for i in range(len(x))]
    assert {i: c for i, (_, c) in got.items()} == dict(enumerate(comp))


def test_lattice_recall_at_the_threshold():
    from lectern.llm import lattice

    rng = np.random.default_rng(7)
    a = rng.standard_normal((3_000, 64))
    a /= np.sqrt((a * a).sum(1))[:, None]
    e = rng.standard_normal(a.shape)
    e -= (e * a).sum(1)[:, None] * a
    e /= np.sqrt((e * e).sum(1))[:, None]
    for cos, least in ((0.93, 0.99), (0.95, 0.999)):
        b = cos * a + math.sqrt(1 - cos * cos) * e
        assert lattice._collides(lattice.cells(a), lattice.cells(b)).any(1).mean() >= least


def test_e8_decoding_is_nearest():
    from lectern.llm.lattice import MINIMAL, decode_e8

    assert len(MINIMAL) == 240 and np.allclose((MINIMAL**2).sum(1), 2)
    x = np.random.default_rng(1).standard_normal((400, 8)) * 2
    p = decode_e8(x) / 2
    d = ((x - p) ** 2).sum(1)
    assert (((x[:, None] - (p[:, None] + MINIMAL[None])) ** 2).sum(2) >= d[:, None] - 1e-9).all()


def test_topk_matches_brute_force(spark):
    from lectern.llm import topk

    rng = np.random.default_rng(2)
    x = np.concatenate([rng.standard_normal((300, 16)), np.ones((20, 16)), np.zeros((5, 16))]).astype(np.float32)
    got = {}
    for r in topk.top_inner_products(vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    v = np.floor(256 * x.astype(float)).astype(int)
    for q in range(0, len(x), 50):
        want = sorted((-int(s), i) for i, s in enumerate(v @ v[q]) if i != q)[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]


def test_threshold_algorithm_stops_early():
    from lectern.llm.topk import SortedLists

    x = np.random.default_rng(4).integers(-50, 50, (20_000, 2))
    x[77] = [1_000, 1_000]
    ids, score, scored = SortedLists(np.arange(20_000), x).top(np.array([3, 2]), 1, -1)
    assert ids.tolist() == [77] and score.tolist() == [5_000] and scored < 200
    big = np.array([[2**40, 1], [2**40, 2]])
    assert SortedLists(np.arange(2), big).top(np.array([2**20, 1]), 1, -1)[1].tolist() == [2**60 + 2]


def test_topk_awkward(spark):
    from lectern.llm.topk import top_inner_products

    rows = [(0 if r[0] == 1 else r[0], *r[1:]) for r in AWKWARD]
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in top_inner_products(vectors(spark, rows)).collect()]
    assert sorted(got) == [(0, 1, 3, 131072), (0, 2, 2, 65536), (0, 3, 9, 65536), (0, 4, 12, 65536), (0, 5, 4, 0)]
    assert top_inner_products(vectors(spark, [])).collect() == []
    assert top_inner_products(vectors(spark, [(0, [1.0], 1)])).collect() == []


@pytest.mark.parametrize("edges", [1_000_000, 20])
def test_components(spark, edges, monkeypatch):
    from lectern.llm import common
    from lectern.llm.common import connected_components

    monkeypatch.setattr(common, "EDGES", edges)

    chain = [(i, i + 1) for i in range(0, 60, 2)] + [(i, i + 1) for i in range(1, 60, 2)] + [(100, 90), (90, 95), (95, 100), (7, 7), (None, 3)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 90: 90, 95: 90, 100: 90}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def records(spark, rows):
    return spark.createDataFrame([(*r, 0, 0) for r in rows], "id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>, t int, part int")


def test_revisits(spark, monkeypatch):
    from lectern.llm import warc

    h = {"etag": "1", "date": "old", "content-type": "text/html"}
    rows = [
        (1, "http://www.A.org/x/?utm_source=q", 10, "response", "1", None, "d1", h),
        (2, "https://a.org:443/x#top", 20, "revisit", "W/1", None, None, {"date": "new", "content-type": "other", "age": "5"}),
        (3, "a.org/x", 15, "response", "2", "lm", "d3", h),
        (4, "a.org/x", 30, "revisit", "1", None, None, None),
        (5, "a.org/x", 30, "revisit", None, "lm", None, None),
        (6, "a.org/x", 31, "revisit", None, None, None, {}),
        (7, "a.org/x", 10, "revisit", "1", None, None, {}),
        (8, None, 10, "revisit", "1", None, None, {}),
        (9, "b.org?b=2&a=1", 1, "response", None, None, "d9", None),
        (10, "b.org/?a=1&b=2", 2, "revisit", "1", None, None, {"etag": "1"}),
        (11, "a.org/x", None, "response", "9", None, "d", {}),
        (11, "a.org/x", 40, None, "9", None, "d", {}),
    ]
    for most in (10_000, 2):
        monkeypatch.setattr(warc, "ORDERED", most)
        got = {r.id: r for r in warc.resolve_revisits(records(spark, rows)).collect()}
        assert {i: (r.outcome, r.response_id) for i, r in got.items()} == {2: ("mismatch", 3), 4: ("mismatch", 3), 5: ("resolved", 3), 6: ("unchecked", 3), 7: ("missing", None), 8: ("missing", None), 10: ("unchecked", 9)}
        assert got[5].headers == h and got[5].digest == "d3" and got[2].digest is None and got[10].headers == {"etag": "1"}
    assert warc.resolve_revisits(records(spark, [])).collect() == []
    one = warc.resolve_revisits(records(spark, [rows[0], rows[1]])).collect()[0]
    assert one.outcome == "resolved" and one.headers == {"etag": "1", "date": "new", "content-type": "text/html", "age": "5"}


def test_warc_files(spark, tmp_path):
    from lectern.llm.warc import format_warc, parse_warc, read_warc

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nETag: \"1\"\r\n\r\n<p>hi\r\n\r\nWARC/1.1 inside</p>"
    parts = [format_warc("response", "<urn:1>", "http://a.org/", "2024-01-01T00:00:00Z", http), format_warc("warcinfo", "<urn:2>", "", "2024-01-01T00:00:00Z", b"software: x")]
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    (tmp_path / "c.warc").write_bytes(b"")
    (tmp_path / "d.warc").write_bytes(parts[0][:-30])
    rows = read_warc(spark, str(tmp_path)).collect()
    assert len(rows) == 4 and {r.warc_type for r in rows} == {"response", "warcinfo"}
    r = next(r for r in rows if r.warc_type == "response")
    assert r.status == 200 and r.headers == {"content-type": "text/html", "etag": '"1"'} and bytes(r.body).startswith(b"<p>hi")
    assert list(parse_warc(b"junk")) == []


def test_revisits_of_a_hot_url_with_odd_times(spark, monkeypatch):
    """One URL with an outlying ts, equal ts and many parts, against a plain search; every outcome of the query occurs."""
    from lectern.llm import warc
    from lectern.llm.queries import QUERIES

    monkeypatch.setattr(warc, "ORDERED", 50)
    monkeypatch.setattr(warc, "PARTS", 8)
    rows = [(i, "http://a.org/x", 10**9 if i == 7 else 500 if i % 3 == 0 else i, "response" if i % 4 == 0 else "revisit", f'"{i % 5}"', None, f"d{i}", {"n": str(i)}) for i in range(1_000)]
    df = spark.createDataFrame(rows, "id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>")
    got = {r.id: (r.response_id, r.outcome) for r in warc.resolve_revisits(df).collect()}
    full = [(r[2], r[0], r[4]) for r in rows if r[3] == "response"]
    want = {}
    for r in rows:
        if r[3] == "revisit":
            best = max((x for x in full if x[0] < r[2]), default=None)
            want[r[0]] = (best and best[1], "missing" if not best else "resolved" if best[2] == r[4] else "mismatch")
    assert got == want
    query = QUERIES["op8_revisits"](spark, "/root/testdata/sf0.01").select("outcome").distinct().collect()
    assert {r.outcome for r in query} == {"resolved", "unchecked", "mismatch", "missing"}
