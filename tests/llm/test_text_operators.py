"""Near-duplicates, passages, encoding, licences, quality, toxicity, mixing over awkward tables and brute force."""

import collections
import hashlib
import itertools
import re

import numpy as np
import pytest
from tests.llm import edge


def shingle_sets(rows, k):
    out = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def brute_components(sets, percent):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(sorted(sets), 2):
        n = len(sets[i] & sets[j])
        if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def test_repeated_ids_with_other_texts(spark):
    """A doc_id with several sets has the links of each of them; the pipeline's form keeps texts apart."""
    from lectern.llm.minhash import near_duplicates, one_of_each_group

    a, b, c, d = (edge.words(80, 900 + i) for i in range(4))
    rows = [(1, a, "en", "s"), (2, b, "en", "s"), (9, a + " more", "en", "s"), (9, b, "en", "s"), (9, b.upper(), "en", "s"), (5, c, "en", "s"), (5, d, "en", "s"), (6, d, "en", "s"), (4, "", "en", "s"), (4, d + " end", "en", "s"), (None, a, "en", "s")]
    docs = edge.documents(spark, rows)
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_duplicates(docs, k=3, percent=85, bands=20).collect()}
    assert got == {(1, 78): (1, True), (2, 78): (1, False), (9, 79): (1, False), (9, 78): (1, False), (5, 78): (4, False), (6, 78): (4, False), (4, 0): (4, True), (4, 79): (4, True)}
    kept = [(r.doc_id, r.text) for r in one_of_each_group(docs).collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (2, b), (5, c), (4, ""), (4, d + " end"), (None, a)], key=str)


@pytest.mark.parametrize("block", [1_000, 3])
def test_near_duplicates_match_brute_force(spark, block, monkeypatch):
    from lectern.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK_DOCS", block)
    rows = []
    for g in range(6):
        w = edge.words(90, 50 + g).split()
        for c in range(5):
            v = list(w)
            for p in range(c):
                v[7 * p + c] = f"x{c}{p}"
            rows.append((10 * g + c, " ".join(v), "en", "s"))
    got = {r.doc_id: r for r in minhash.near_duplicates(edge.documents(spark, rows), k=3, percent=85, bands=20).collect()}
    sets = shingle_sets([r[:2] for r in rows], 3)
    want = brute_components(sets, 85)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_near_duplicates_awkward(spark):
    from lectern.llm.minhash import near_duplicates

    rows = near_duplicates(edge.documents(spark), k=3, percent=85, bands=20).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 14 - 1 and None not in by  # the repeated row is one, the null id is dropped
    assert by[2].component_id == by[3].component_id == 1 and not by[2].kept
    assert all(by[i].n_shingles == 0 and by[i].kept for i in (4, 5, 6)) and by[7].n_shingles == 1
    assert near_duplicates(edge.documents(spark, [])).collect() == []


def test_compact_windows_match_brute_force():
    from lectern.llm import passages as P
    from lectern.llm.common import mix64, seeds

    rng = np.random.default_rng(3)
    for t in (2, 5, 9):
        sizes = rng.integers(0, 50, 8)
        off = np.concatenate(([0], np.cumsum(sizes)))
        sh = rng.integers(0, 1 << 62, off[-1]).astype(np.uint64)
        for f, (_, doc, c, lo, hi, _) in enumerate(P.compact_windows(sh, off, t, 3)):
            want = set()
            v = mix64(sh * seeds(3, 31)[f])
            for d in range(8):
                x = v[off[d] : off[d + 1]].tolist()
                for i in range(len(x)):
                    a = b = i
                    while a > 0 and x[a - 1] > x[i]:
                        a -= 1
                    while b + 1 < len(x) and x[b + 1] > x[i]:
                        b += 1
                    if b - a + 1 >= t:
                        want.add((d, i, a, b))
            assert set(zip(doc.tolist(), c.tolist(), lo.tolist(), hi.tolist(), strict=True)) == want


@pytest.mark.parametrize("common", [8, 2])
def test_passages_find_verbatim_runs(spark, common, monkeypatch):
    from lectern.llm import passages
    from lectern.llm.passages import cut_passages, repeated_passages

    monkeypatch.setattr(passages, "COMMON", common)
    monkeypatch.setattr(passages, "COMBINED", 50 * common)

    p, q = edge.words(60, 70, 9_000), edge.words(30, 71, 9_000)
    rows = [(i, f"{edge.words(80, 100 + i, 9_000)} {p if i % 2 else q} {edge.words(80, 200 + i, 9_000)}", "en", "s") for i in range(12)]
    found = repeated_passages(edge.documents(spark, rows))
    got = {(r.doc_id, r.source_doc_id) for r in found.collect()}
    assert {i for i, _ in got} == {3, 5, 7, 9, 11} and all(a % 2 and a < i for i, a in got)
    cut = {r.doc_id: r.text for r in cut_passages(edge.documents(spark, rows), found).collect()}
    assert p in cut[1] and all(p not in cut[i] and len(cut[i].split()) == 160 for i in (3, 5)) and cut[2] == rows[2][1]


def test_passages_meet_later_documents_of_common_hashes(spark):
    from lectern.llm.passages import repeated_passages

    p = edge.words(60, 854, 9_000).split()  # no least hash of q stands in its own words
    q = p[:25] + edge.words(10, 81, 9_000).split() + p[35:]
    text = lambda i: " ".join([edge.words(80, 1_000 + i, 9_000), *(q if i in (101, 150) else p), edge.words(80, 2_000 + i, 9_000)])
    docs = edge.documents(spark, [(i, text(i), "en", "s") for i in range(1, 151)])
    got = collections.defaultdict(set)
    for parts in (1, 7):
        for r in repeated_passages(docs.repartition(parts)).collect():
            if r.doc_id == 150 and r.source_doc_id == 101:
                got[parts].update(range(r.start_word, r.start_word + r.n_words))
        assert set(range(82, 138)) <= got[parts]


def test_passages_compare_the_same_whatever_the_layout(spark, monkeypatch):
    from lectern.llm import passages
    from lectern.llm.passages import repeated_passages

    line, p = edge.words(42, 308, 9_000), edge.words(18, 91, 9_000)  # all least hashes stand in the line
    ends = lambda i: f"{edge.words(60, 3_000 + i, 9_000)} {line} {p if i in (5, 25) else edge.words(18, 4_000 + i, 9_000)}"
    docs = edge.documents(spark, [(i, ends(i), "en", "s") for i in range(30)])
    found = []
    for parts, rows in ((1, 400_000), (6, 400_000), (1, 100)):
        monkeypatch.setattr(passages, "COMBINED", rows)
        found.append({tuple(r) for r in repeated_passages(docs.repartition(parts, "doc_id")).collect()})
    assert found[0] == found[1] == found[2] and (25, 5) in {x[:2] for x in found[0]}


def near_copy(words, edits, seed):
    """The words with some replaced, spread evenly."""
    out = list(words)
    for n in range(edits):
        out[int((n + 0.5) * len(out) / edits)] = f"edit{seed}x{n}"
    return out


def runs_of(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_passages_find_near_copies_whatever_the_layout(spark):
    """Passages of 140 words at Jaccard 0.80 to 0.93, alone and in groups with a frequent line: nine of ten are found."""
    from lectern.llm.passages import repeated_passages

    line = edge.words(20, 77, 9_000)
    rows, pairs, doc = [], [], 1
    for g in range(60):
        p = edge.words(140, 5_000 + g, 9_000).split()
        if g % 2:
            p[50:70] = line.split()  # a line that all of these hold
        q = near_copy(p, 1 + g % 3, g)
        x, y = runs_of(p), runs_of(q)
        assert len(x & y) >= 0.8 * len(x | y)
        for w in (p, q):
            rows.append((doc, " ".join([edge.words(60, 7_000 + doc, 9_000), *w, edge.words(60, 8_000 + doc, 9_000)]), "en", "s"))
            doc += 1
        pairs.append((doc - 1, doc - 2))
    docs = edge.documents(spark, rows)
    found = []
    for parts in (1, 4, 16):
        found.append({tuple(r) for r in repeated_passages(docs.repartition(parts, "doc_id")).collect()})
    assert found[0] == found[1] == found[2]
    assert len({x[:2] for x in found[0]} & set(pairs)) >= 0.9 * len(pairs)
    words = {r[0]: r[1].split() for r in rows}
    for b, a, start, n, where, j in found[0]:
        x = runs_of(words[b][start : start + n])
        assert j >= 0.8 and (b, a) in pairs and len(x & runs_of(words[a])) >= 0.8 * len(x)


def test_passages_of_common_hashes_meet_beyond_the_first(spark):
    """Edited passages that two later documents share, not word for word, while many hold another form of them."""
    from lectern.llm.passages import repeated_passages

    rows, pairs = [], []
    for g in range(10):
        p = edge.words(60, 854 + g, 9_000).split()
        q = p[:12] + edge.words(30, 81 + g, 9_000).split() + p[42:]  # too unlike p
        r = near_copy(q, 1, 9)  # one word in sixty: like q, and no run of fifty is the same
        assert len(runs_of(q) & runs_of(r)) >= 0.8 * len(runs_of(q) | runs_of(r)) and len(runs_of(p) & runs_of(r)) < 0.6 * len(runs_of(p))
        for i in range(100 * g, 100 * g + 44):
            rows.append((i, " ".join([edge.words(80, 1_000 + i, 9_000), *(q if i % 100 == 20 else r if i % 100 == 40 else p), edge.words(80, 2_000 + i, 9_000)]), "en", "s"))
        pairs.append((100 * g + 40, 100 * g + 20))
    got = {(x.doc_id, x.source_doc_id) for x in repeated_passages(edge.documents(spark, rows)).collect()}
    assert len(got & set(pairs)) >= 9


def test_passages_of_common_hashes_meet_in_families(spark):
    """Pairs at similarity 0.84 in families of 50 documents that share 46 of their 60 words: neither is like the first or the one before."""
    from lectern.llm.passages import repeated_passages

    rows, pairs = [], []
    for g in range(8):
        shared = edge.words(46, 40 + g, 9_000).split()
        for i in range(50):
            own = edge.words(14, 100_000 + 1_000 * g + (i if i % 5 else 5 * (i // 10)), 9_000).split()  # 0 and 5, 10 and 15, ...
            p = own[:7] + shared + own[7:]
            if i % 10 == 5:
                p[30] = f"edit{g}x{i}"
                pairs.append((100 * g + i, 100 * g + i - 5))
            rows.append((100 * g + i, " ".join([edge.words(60, 200_000 + 1_000 * g + i, 9_000), *p, edge.words(60, 300_000 + 1_000 * g + i, 9_000)]), "en", "s"))
    got = {(x.doc_id, x.source_doc_id) for x in repeated_passages(edge.documents(spark, rows)).collect()}
    assert len(got & set(pairs)) >= 0.95 * len(pairs)


def test_block_links_join_what_brute_force_joins():
    from lectern.llm.passages import block_links, similar_spans

    rng = np.random.default_rng(8)
    base = [rng.integers(0, 1 << 62, 60).astype(np.uint64) for _ in range(4)]
    pieces = []
    for i in range(60):
        p = base[i % 4].copy()
        at = rng.integers(0, 50)
        p[at : at + 5] = rng.integers(0, 1 << 62, 5)
        pieces.append(p if i % 7 else np.resize(p[:3], 60))  # some are periodic
    docs, zero = np.arange(60) // 2, np.zeros(60, np.int64)

    def joined(links):
        root = list(range(60))
        for x, y in links:
            root = [root[x] if r == root[y] else r for r in root]
        return {frozenset(i for i in range(60) if root[i] == r) for r in root}

    want = joined([(x, y) for x in range(60) for y in range(x + 1, 60) if docs[x] != docs[y] and similar_spans(pieces[x], pieces[y], 46, 0.8)])
    every, halves = np.arange(60), np.split(np.arange(60), 2)
    links = block_links(pieces, docs, every, every, 46, 0.8, zero)
    assert joined(links) == want and len(links) == 60 - len(want)
    parts = [x for a, b in ((0, 0), (0, 1), (1, 1)) for x in block_links(pieces, docs, halves[a], halves[b], 46, 0.8, zero)]
    assert joined(parts) == want


def test_near_copies_are_linked_each_with_each(spark):
    """More near copies than a key's contents that meet unasked: no link between two different ones is left out."""
    from lectern.llm.passages import block_links, repeated_passages, similar_spans

    base, rows = edge.words(54, 77, 9_000).split(), []
    for i in range(20):
        rows.append((i + 1, " ".join([*base[:27], f"changed{i}", *base[28:]]), "en", "s"))
    got = {(x.doc_id, x.source_doc_id) for x in repeated_passages(edge.documents(spark, rows)).collect()}
    assert len(got) >= 0.98 * 190  # a pair is met with a probability, 0.996 here

    rng = np.random.default_rng(10)
    pieces = [np.concatenate((rng.integers(0, 1 << 62, 20).astype(np.uint64), p, p[:10])) for p in [rng.integers(0, 1 << 62, 60).astype(np.uint64)] * 30]
    for i, p in enumerate(pieces):
        p[25 + i : 28 + i] = i
    docs, zero, halves = np.arange(30) // 2, np.zeros(30, np.int64), np.split(np.arange(30), 2)
    want = {(x, y) for x in range(30) for y in range(x + 1, 30) if docs[x] != docs[y] and similar_spans(pieces[x], pieces[y], 46, 0.8)}
    for parts in ([(np.arange(30), np.arange(30))], [(halves[0], halves[0]), (halves[0], halves[1]), (halves[1], halves[1])]):
        links = np.concatenate([block_links(pieces, docs, a, b, 46, 0.8, zero, every=True) for a, b in parts]).tolist()
        assert want and len(links) == len(set(map(tuple, links))) and want <= set(map(tuple, links))


def test_block_links_look_at_one_piece_of_a_component(monkeypatch):
    """Two blocks of near copies: a piece that one of a component has joined isn't held against the rest of it."""
    from lectern.llm import passages as P

    rng = np.random.default_rng(9)
    base, pieces = rng.integers(0, 1 << 62, 60).astype(np.uint64), []
    for i in range(200):
        p = base.copy()
        p[i % 60] = i
        pieces.append(p)
    rows, stretch = [], P._stretch
    monkeypatch.setattr(P, "_stretch", lambda where, *rest: rows.append(len(where)) or stretch(where, *rest))
    links = P.block_links(pieces, np.arange(200), np.arange(0, 200, 2), np.arange(1, 200, 2), 46, 0.8, np.zeros(200, np.int64))
    assert len(links) == 199 and sum(rows) <= 2 * 200 * 15  # of 100 * 100 pairs, with 15 runs each


def test_whole_spans_give_what_similar_spans_gives():
    from lectern.llm.passages import similar_spans, whole_spans

    rng = np.random.default_rng(3)
    a, b = [], []
    for i in range(300):
        x = rng.integers(0, 40 if i % 3 == 0 else 1 << 62, rng.integers(30, 200)).astype(np.uint64)
        y = np.concatenate((rng.integers(0, 1 << 62, rng.integers(0, 30)).astype(np.uint64), x[rng.integers(0, 20) :]))
        y[rng.integers(0, len(y), rng.integers(0, 9))] = 5
        a.append(np.resize(x[:3], 100) if i % 50 == 1 else x)
        b.append(np.resize(y[-3:], 100) if i % 50 in (1, 2) else y[:0] if i % 50 == 3 else y)
    shift = rng.integers(-40, 40, 300)
    rows, left = whole_spans(a, b, shift, 46, 0.8)
    want = [(i, *x) for i in range(300) for x in similar_spans(a[i], b[i], 46, 0.8, int(shift[i]))]
    assert sorted(rows) == sorted(x for x in want if not left[x[0]])
    assert len(rows) > 100 and left.any() and {x[0] for x in rows} & set(range(0, 300, 3))


def test_runs_of_repeating_shingles_count_each_once():
    from lectern.llm.passages import _before, _occurrence, _repeating

    rng, t, some = np.random.default_rng(12), 46, 0
    for i in range(60):
        a = rng.integers(0, (3, 30, 200)[i % 3], rng.integers(60, 200)).astype(np.uint64)
        b = np.concatenate((rng.integers(0, 30, 9).astype(np.uint64), a[rng.integers(0, 9) :]))
        b[rng.integers(0, len(b), 4)] = 500
        hit, where = _occurrence(a, b, -5)
        code = np.unique(np.concatenate((a, b)), return_inverse=True)[1]
        before = [_before(x, np.zeros(len(x), np.int64)) for x in (a, b)]
        first, similarity = _repeating(np.arange(len(b) - t + 1), t, where, hit, code[: len(a)], code[len(a) :], *before)
        for s in range(len(b) - t + 1):
            at = np.flatnonzero(hit[s : s + t]) + s
            if not len(at):
                assert similarity[s] == 0
                continue
            off = where[at] - at
            near = where[at][np.abs(off - int(np.median(off))) <= t // 2]
            if not len(near):
                assert similarity[s] == 0
                continue
            x, y = set(a[near.min() : near.max() + 1].tolist()), set(b[s : s + t].tolist())
            assert first[s] == near.min() and similarity[s] == len(x & y) / len(x | y)
            some += 1
    assert some > 1_000


def test_passages_of_periodic_text_need_few_rows(monkeypatch):
    import pyarrow as pa
    from lectern.llm import passages as P

    t, text = 46, [" ".join([edge.words(60, 7 + i, 9_000), *["on", "the"] * 200, edge.words(60, 90 + i, 9_000)]) for i in range(4)]
    asked = [[{"c": c, "l": 0, "r": 10_000} for c in range(0, 520, t)]] * 4
    batch = pa.RecordBatch.from_pydict({"doc": list(range(4)), "text": text, "asked": asked})
    runs = pa.Table.from_batches(list(P._runs_of(5, t)([batch]))).sort_by([("run", "ascending"), ("doc", "ascending"), ("start", "ascending")])

    def regions(size):
        met = pa.Table.from_batches([b for b in P._same_of(t)(iter(runs.combine_chunks().to_batches(size)))]).sort_by([("b", "ascending"), ("a", "ascending"), ("cb", "ascending")])
        return met.num_rows, pa.Table.from_batches(list(P._regions_of(t)(iter(met.to_batches())))).to_pydict()

    few, want = regions(100_000)
    assert regions(97)[1] == want
    monkeypatch.setattr(P, "_spread", lambda run, doc, start, step: np.ones(len(run), bool))
    many, got = regions(100_000)
    assert got == want and len(want["b"]) >= 3 and few * 5 < many


def test_similar_spans_align_repeats_to_their_own_place():
    from lectern.llm.passages import similar_spans

    rng = np.random.default_rng(5)
    line, x, y = (rng.integers(0, 1 << 62, n).astype(np.uint64) for n in (30, 60, 60))
    a = np.concatenate((line, x, line, y))  # the line stands twice
    (lo, hi, where, j), *rest = similar_spans(a, np.concatenate((line, y)), 46, 0.8, 90)
    assert (lo, hi, where, j) == (0, 89, 90, 1.0) and not rest
    same = np.full(100, 7, np.uint64)
    assert similar_spans(same, same, 46, 0.8)[0][:2] == (0, 99)


def test_passages_awkward(spark):
    from lectern.llm.passages import cut_passages, repeated_passages

    d = edge.documents(spark)
    found = repeated_passages(d)
    assert {r.doc_id for r in found.collect()} == {2, 3, 10}
    assert cut_passages(d, found).columns == d.columns and cut_passages(d, found).count() == d.count()
    assert repeated_passages(edge.documents(spark, [])).collect() == []


def test_encoding_matches_tiktoken_and_round_trips(spark):
    import public_tokenizers
    import tiktoken

    from lectern.llm import bpe

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    rows = [(i, t) for i, t in enumerate(["aaaaaaa", "abcabcababab " * 50, "don't we'll", "naïve 漢字 😀", "  \n\n x", "<|endoftext|>", "x" * 20_000])]
    d = edge.documents(spark).select("doc_id", "text").unionAll(spark.createDataFrame([(1000 + i, t) for i, t in rows], "doc_id long, text string"))
    got = bpe.encode_documents(d, path, public_tokenizers.PATTERN, ["doc_id"], digests=True)
    texts = collections.defaultdict(list)
    for r in d.collect():
        texts[r.doc_id].append(r.text or "")
    for r in got.collect():
        want = [enc.encode_ordinary(t) for t in texts[r.doc_id]]
        assert r.ids in want and r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 in [hashlib.sha256(t.encode()).hexdigest() for t in texts[r.doc_id]]
    back = {r.doc_id: r.bytes.decode() for r in bpe.decode_ids(got, path, ["doc_id"]).collect()}
    assert back[1006] == "x" * 20_000
    assert bpe.encode_documents(d.limit(0), path, public_tokenizers.PATTERN, ["doc_id"]).collect() == []


def test_licenses(spark):
    from lectern.llm.licenses import TEMPLATES, anchors, bigrams, scan_licenses

    rows = [(100 + i, f"Some words before.\n\n{t.upper()}\n\nand after it.", "en", "s") for i, t in enumerate(TEMPLATES.values())]
    d = edge.documents(spark).unionAll(edge.documents(spark, rows))
    got = {(r.doc_id, r.license): r for r in scan_licenses(d).collect()}
    names = list(TEMPLATES)
    assert all((100 + i, n) in got and got[100 + i, n].dice == 1.0 for i, n in enumerate(names)) and (11, "Apache-2.0") in got
    assert not any(i in range(1, 11) for i, _ in got)
    assert scan_licenses(edge.documents(spark, [])).collect() == []
    keys = set(anchors(TEMPLATES, 0.8))  # dropping the anchors leaves every template below the threshold
    for t in TEMPLATES.values():
        p = bigrams(t)
        rest = [b for b in p if not keys & set(b.split())]
        assert 2 * len(rest) / (len(p) + len(rest)) < 0.8


def test_sibling_licences_keep_their_names(spark):
    from lectern.llm.licenses import TEMPLATES, scan_licenses

    names = ["GPL-2.0-notice", "GPL-3.0-notice", "LGPL-2.1-notice", "LGPL-3.0-notice", "AGPL-3.0-notice", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-SA-4.0-sentence", "CC-BY-NC-4.0-sentence", "GPL-2.0"]
    rows = [(i, f"Words before it.\n\n{TEMPLATES[n].replace('copyright holder nor', 'author nor')}\n\nWords after it.", "en", "s") for i, n in enumerate(names)]
    rows.append((50, TEMPLATES["BSD"] + "\n\nOther words.", "en", "s"))  # which of them isn't said
    got = collections.defaultdict(set)
    for r in scan_licenses(edge.documents(spark, rows)).collect():
        got[r.doc_id].add(r.license)
    assert got == {i: {n} for i, n in enumerate(names)} | {50: {"BSD"}}


def test_quality(spark):
    from lectern.llm.quality import accepted_documents, quality_scores

    d, y = edge.documents(spark), edge.labels(spark)
    got = quality_scores(d, y).collect()
    assert len(got) == d.count() and all(0 <= r.quality <= 1 and 0 < r.path_rate < 1 for r in got)
    kept = accepted_documents(d, edge.labels(spark, []))
    assert kept.columns == d.columns and kept.count() == d.count()  # nothing learnt: all accepted
    assert quality_scores(edge.documents(spark, []), y).collect() == []


def test_quality_rejects_junk(spark):
    from lectern.llm.quality import accepted_documents

    good = [(i, edge.words(80, i) + ".", "en", "s") for i in range(60)]
    junk = [(100 + i, " ".join(w + "$$$" for w in edge.words(80, i).split()), "en", "s") for i in range(60)]
    y = [(i, 1, 0) for i in range(40)] + [(100 + i, 0, 0) for i in range(40)]
    kept = {r.doc_id for r in accepted_documents(edge.documents(spark, good + junk), edge.labels(spark, y)).collect()}
    assert kept == {r[0] for r in good}


def test_toxicity(spark):
    from lectern.llm.toxicity import Counter, Model, score_toxicity

    d, y = edge.documents(spark), edge.labels(spark)
    got = score_toxicity(d, y).collect()
    assert len(got) == d.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert {r.score for r in score_toxicity(d, edge.labels(spark, [])).collect()} == {0.5}
    assert score_toxicity(edge.documents(spark, []), y).collect() == []
    rows = [(i, Counter((edge.words(40, i) + (" vilebad" + "abc"[i % 3] if i % 5 == 0 else "")).split()), int(i % 5 == 0)) for i in range(300)]
    m = Model(rows)
    assert m.score(Counter((edge.words(40, 999) + " vilebadz").split()))[0] > 0.9 and m.score(Counter(edge.words(40, 998).split()))[0] < 0.5


def brute_votes(rows, words):
    """The vote for a document by full cosine with all examples, after the definition; rows: id, word counts, label."""
    import math

    from lectern.llm import toxicity as T

    n, base = len(rows), (sum(y for _, _, y in rows) + 0.5) / (len(rows) + 1)
    m = T.Model(rows)  # for which terms are lifted only
    df = collections.Counter(f for _, w, _ in rows for f in {f for x in w for f in T.features_of(x)})
    lifted = {f for f, i in m.terms.items() if m.weight[i] > 1.5 * (math.log((1 + n) / (1 + df[f])) + 1)}

    def vector(w):
        tf = collections.Counter()
        for x, k in w.items():
            tf[x] += k
            for f in T.features_of(x)[1:]:
                tf[f] += k if f in lifted else 0
        v = {f: (1 + math.log(k)) * (math.log((1 + n) / (1 + df[f])) + 1) * (T.LIFT if f in lifted else 1) for f, k in tf.items() if k}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {f: x / norm for f, x in v.items()}

    q = vector(words)
    scored = []
    for i, w, y in rows:
        v = vector(w)
        scored.append((-round(sum(x * v.get(f, 0.0) for f, x in q.items()), 6), i, y))
    near = [x for x in sorted(scored) if x[0] < 0][: T.NEIGHBOURS]
    weights = [x[0] ** 2 for x in near]
    return (sum(w * x[2] for w, x in zip(weights, near, strict=True)) + T.PRIOR * base) / (sum(weights) + T.PRIOR), [x[1] for x in near[:3]]


def test_toxicity_votes_match_full_search(monkeypatch):
    from lectern.llm import toxicity as T

    monkeypatch.setattr(T, "BLOCK", 8)
    text = lambda i: edge.words(10 + i % 50, i, 60 + 400 * (i % 2)) + (" vilebad" + "abc"[i % 3] if i % 5 == 0 else "")
    rows = [(i, T.Counter(text(i).split()), int(i % 5 == 0)) for i in range(200)]
    m = T.Model(rows)
    for i in (*range(0, 40), 777, 778, 779):
        words = T.Counter(text(i).split())
        (got, near), (want, order) = m.vote(words), brute_votes(rows, words)
        assert abs(got - want) < 1e-4 and (near == order or i > 700)


def off_by(plan, weight):
    """Greatest distance of a source's blocks from its weight times the slots so far, before and after each of its blocks."""
    at = collections.defaultdict(list)
    for slot, s in plan:
        at[s].append(slot)
    return max(max(abs(b - weight[s] * slot), abs(b + 1 - weight[s] * (slot + 1))) for s, slots in at.items() for b, slot in enumerate(slots))


@pytest.mark.parametrize(("sources", "first", "most"), [(3, 0.5, 400), (50, 0.5, 300), (200, 0.9, 120), (1_200, 0.9, 40)])
def test_mixing_holds_the_weights(spark, sources, first, most):
    """Unequal weights of few and many sources: less than one block from the weight itself, in every prefix."""
    from lectern.llm import mixing

    rest = [1 + i % 7 for i in range(1, sources)]
    weight = {"s0": first, **{f"s{i + 1}": (1 - first) * w / sum(rest) for i, w in enumerate(rest)}}
    blocks = {s: 1 if s != "s1" and sources > 200 else max(1, round(w * most)) for s, w in weight.items()}
    table = spark.createDataFrame([(s, w, blocks[s]) for s, w in weight.items()], "source string, weight double, blocks long")
    whole = mixing.whole_weights(table)
    if sources > 200:  # short sources but one, so that the fold ends early
        blocks = dict.fromkeys(blocks, 1) | {"s0": most}
        table = table.withColumn("blocks", (table.source == "s0").cast("long") * (most - 1) + 1)
    plan = sorted((r.slot, r.source) for r in mixing.schedule(whole.join(table.select("source", "blocks"), "source")).collect())
    assert len(plan) == len({slot for slot, _ in plan}) and off_by(plan, weight) < 1 + 1e-6
    got = collections.Counter(s for _, s in plan)
    assert sum(got[s] < n for s, n in blocks.items()) <= 1  # only the last source may have blocks left


def test_mixing_keeps_all_documents(spark, monkeypatch):
    from lectern.llm import mixing

    d = edge.documents(spark, [(i, "x", "en", "abc"[min(2, i % 7 // 3)]) for i in range(3_000)])
    w = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 5.0)], "source string, weight double")
    for slots in (1 << 18, 64):  # few slots make larger blocks
        monkeypatch.setattr(mixing, "SLOTS", slots)
        got = mixing.mix(d, w).collect()
        assert len({(r.slot, r.place, r.source) for r in got}) == len(got) == 3_000
        share = {"a": 0.3, "b": 0.2, "c": 0.5}
        ends = {s: max(r.slot for r in got if r.source == s) for s in share}
        plan = sorted({(r.slot, r.source) for r in got if r.slot <= min(ends.values())})
        assert off_by(plan, share) < 1 + 1e-6 and len(plan) == len({s for s, _ in plan})


def test_mixing_is_the_same_in_many_rounds(spark, monkeypatch):
    """Earliest deadline first in blocks of BLOCK_DOCS, whatever number of slots one round of the fold has."""
    from lectern.llm import mixing

    d = edge.documents(spark, [(i, "x", "en", "abc"[min(2, i % 7 // 3)]) for i in range(3_000)])
    w = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 5.0)], "source string, weight double")
    one = sorted(mixing.mix(d, w).collect())
    monkeypatch.setattr(mixing, "SLOTS", 100)
    assert sorted(mixing.mix(d, w).collect()) == one and max(r.slot for r in one) > 200


def test_mixing_awkward(spark):
    from lectern.llm import mixing

    d = edge.documents(spark)
    w = mixing.target_weights(d)
    assert mixing.mix(d, w).count() == d.count()
    out = mixing.mix(d, w, keep=d.columns)
    assert out.columns == [*d.columns, "__slot", "__place"] and out.count() == d.count()
    assert mixing.mix(d, spark.createDataFrame([("s", None)], "source string, weight double")).count() == d.count()
    e = edge.documents(spark, [])
    assert mixing.mix(e, mixing.target_weights(e)).collect() == []


@pytest.mark.parametrize("order", itertools.permutations(range(3)))
def test_passages_of_repeated_ids_with_other_texts(spark, order):
    """In any order of the rows the passage is found once and cut from the text that holds it, and from no other."""
    from lectern.llm.passages import cut_passages, repeated_passages

    p = edge.words(60, 70)
    held, other = p + " " + edge.words(20, 71), edge.words(100, 72)
    rows = [(1, p, "en", "s"), (2, held, "en", "s"), (2, other, "en", "s")]
    docs = edge.documents(spark, [rows[i] for i in order]).coalesce(1)
    spans = repeated_passages(docs, forms=True)
    assert [(r.doc_id, r.source_doc_id, r.start_word, r.n_words) for r in spans.collect()] == [(2, 1, 0, 60)]
    assert "form" not in repeated_passages(docs).columns
    left = sorted((r.doc_id, len(r.text.split())) for r in cut_passages(docs, spans).collect())
    assert left == [(1, 60), (2, 20), (2, 100)]


def test_passages_between_texts_of_one_id(spark):
    from lectern.llm.passages import cut_passages, repeated_passages

    p = edge.words(60, 80)
    docs = edge.documents(spark, [(5, p + " " + edge.words(30, 81), "en", "s"), (5, edge.words(30, 82) + " " + p, "en", "s"), (5, edge.words(30, 82) + " " + p, "en", "s"), (None, p, "en", "s"), (6, None, "en", "s"), (6, "", "en", "s")])
    spans = repeated_passages(docs, forms=True)
    assert [(r.doc_id, r.source_doc_id, r.n_words) for r in spans.collect()] == [(5, 5, 60)]
    left = sorted(len(r.text.split()) for r in cut_passages(docs, spans).where("doc_id = 5").collect())
    assert left in ([30, 90, 90], [30, 30, 90])
