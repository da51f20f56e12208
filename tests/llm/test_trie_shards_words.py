"""Conversation trie, shards and spelling variants over awkward tables and against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from tests.llm import edge

TURNS = "conv_id long, turn long, role string, text string, " + edge.CLASHES + ", conv long, depth long, h long, owner long, value int, mark int, words int, last int"


def turns_table(spark, rows):
    n = len(TURNS.split(",")) - 4
    return spark.createDataFrame([(*r, *(None,) * n) for r in rows], TURNS)


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + v[h:]
    return out


def brute_trie(convs):
    member = defaultdict(list)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            member[tuple(seq[:d])].append(c)
    words = lambda k: len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
    child = Counter(k[:-1] for k in member if k)
    out = {}
    for k, m in member.items():
        below = [x for x in member if x[: len(k)] == k]
        ends = sorted(c for c in m if len(convs[c]) == len(k))
        out[(min(m), len(k))] = (
            min(member[k[:-1]]) if k else None, len(m), child[k], sum(1 for x in below if not child[x]),
            sum((len(member[x]) - 1) * words(x) for x in below), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )
    return out


def trie_rows(df):
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()}


def conversations(seed, n):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.choice([0, 1, 2, 3, 5, 9])):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice(["", None, "a", "a b", "hello there you"])))
    return rows + rows[:3] + [(45, None, "system", "first"), (None, 1, "user", "gone"), (3, 1, "user", " \x0b\n")]


@pytest.mark.parametrize("bits,block", [(64, 4096), (2, 4096), (64, 3)])
def test_trie_matches_brute_force(spark, bits, block, monkeypatch):
    """Also with fingerprints of two bits, so that most groups collide and are split, and in small blocks."""
    from lectern.llm import trie

    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "CHUNK", 5)
    rows = conversations(bits + block, 60)
    got = trie.prefix_trie(*trie.with_shared_heads(turns_table(spark, rows)), bits=bits)
    want = brute_trie(rebuilt(rows))
    assert got.count() == len(want) and trie_rows(got) == want


def test_trie_of_one_long_common_and_no_conversation(spark):
    from lectern.llm.trie import prefix_trie, with_shared_heads

    rows = [(c, t, "user", f"turn {t}") for c in (1, 2, 3) for t in range(300)] + [(c, 0, "user", "x") for c in range(100, 160)]
    convs = defaultdict(list)
    for c, _, role, text in rows:
        convs[c].append((role, text))
    ids = spark.createDataFrame([(i,) for i in (7, 9, None)], "conv_id long")
    convs |= {7: [], 9: []}
    got = prefix_trie(turns_table(spark, rows), ids)
    assert trie_rows(got) == brute_trie(convs)
    assert {(r.role, r.text) for r in got.where("depth = 300").collect()} == {("user", "turn 299")}
    assert with_shared_heads(turns_table(spark, []))[1].count() == 0
    assert prefix_trie(turns_table(spark, [])).collect() == []
    assert trie_rows(prefix_trie(turns_table(spark, []), ids)) == brute_trie({7: [], 9: []})


def brute_shards(rows, shards, seed, bucket_bytes, bucket_rows):
    """Rows (doc_id, text, ...) in the order of the shuffle, by the docstring's rules."""
    draw = lambda *p: int(hashlib.md5(":".join(map(str, p)).encode()).hexdigest()[:15], 16)
    seen, recs = Counter(), []
    for row in rows:
        i, b = row[0], (row[1] or "").encode()
        k = (i, len(b) + 16, zlib.crc32(b))
        recs.append((draw(seed, "" if i is None else i, *k[1:], seen[row]), i, *k[1:], seen[row]))
        seen[row] += 1
    m = max(1, -(-sum(r[2] for r in recs) // bucket_bytes), -(-len(recs) // bucket_rows))
    order = []
    for b in range(m):
        a = sorted((r for r in recs if r[0] % m == b), key=lambda r: (r[0], r[1] is not None, r[1] or 0, *r[2:]))
        for i in range(len(a) - 1, -1, -1):
            j = draw(seed, "swap", b, i) % (i + 1)
            a[i], a[j] = a[j], a[i]
        order += a
    out = []
    for p, r in enumerate(order):
        s = p * shards // len(order)
        out.append((r[1], r[2], r[3], s, p - -(-s * len(order) // shards)))
    return out


@pytest.mark.parametrize("bucket_rows,chunk,parts", [(1000, 1000, 1), (7, 3, 5)])
def test_shards_match_brute_force(spark, bucket_rows, chunk, parts, monkeypatch):
    """Whatever the layout; every row is kept with all its columns, counts differ by one, slots have no gaps."""
    from lectern.llm import sharding

    monkeypatch.setattr(sharding, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(sharding, "CHUNK", chunk)
    monkeypatch.setattr(sharding, "SPAN", 3)
    r = random.Random(5)
    rows = [(i, edge.words(r.randrange(40), i), "en", "s") for i in range(150)] + [(3, "copy", "en", "s")] * 80 + [(None, None, "en", None)] * 3 + [(151, None, "en", "s"), (152, "", "en", "s"), (153, edge.words(20_000, 1), "fr", "s"), (4, "x", "en", "s"), (4, "x", "fr", "s")]
    docs = edge.documents(spark, rows).repartition(parts)
    out = sharding.shuffle_shards(docs, 8, 7).collect()
    got = Counter((x.doc_id, len((x.text or "").encode()) + 16, zlib.crc32((x.text or "").encode()), x["__shard"], x["__slot"]) for x in out)
    assert got == Counter(brute_shards(rows, 8, 7, sharding.BUCKET_BYTES, bucket_rows))
    assert Counter((x.doc_id, x.text, x.lang, x.source) for x in out) == Counter(rows)
    count = Counter(x["__shard"] for x in out)
    assert max(count.values()) - min(count.values()) <= 1
    assert all(sorted(x["__slot"] for x in out if x["__shard"] == s) == list(range(n)) for s, n in count.items())


def test_shards_of_few_rows_and_files(spark, tmp_path):
    from lectern.llm.sharding import shuffle_shards, write_shards

    assert shuffle_shards(edge.documents(spark, []), 8).collect() == []
    few = shuffle_shards(edge.documents(spark, [(i, "t", "en", "s") for i in range(3)]), 8).collect()
    assert len(few) == 3 and len({x["__shard"] for x in few}) == 3 and {x["__slot"] for x in few} == {0}
    docs = edge.documents(spark, [(i, f"t {i}", "en", "s") for i in range(50)], extra=False)
    write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and sorted(r["count"] for r in back.groupBy("shard").count().collect()) == [12, 12, 13, 13]


def brute_counts(rows):
    n = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                n[w] += 1
    return {w: k for w, k in n.items() if k >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n):
    near = {w: [v for v in n if v != w and one_edit(w, v)] for w in n}
    form = {}
    for w, v in near.items():
        best = min(v, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def test_spelling_variants_match_brute_force(spark):
    """Words of few letters, so that bigrams repeat in a word; counts in steps of ten for chains of forms."""
    from lectern.llm.spelling import spelling_variants

    r = random.Random(3)
    words = {"".join(r.choice("ab") for _ in range(r.randrange(4, 10))) for _ in range(250)} | {"".join(r.choice("abcé") for _ in range(r.randrange(7, 12))) for _ in range(250)} | {"a" * k for k in range(4, 13)} | {"\U0001f600abcd", "\U0001f600abce", "x" * 70, "x" * 71}
    n = {w: 2 * 10 ** r.randrange(4) for w in words}
    rows = [(w, k - 1, 1) for w, k in n.items()] + [(w, 1, 1) for w in n] + [(None, 5, 1), ("abc", 9, 1), ("abd", 900, 1)]
    got = {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in spelling_variants(spark.createDataFrame(rows, "word string, n long, len int")).collect()}
    assert got == brute_variants(n) | {"abc": (None, "abc", 9, 0, None), "abd": (None, "abd", 900, 0, None)}
    assert any(v[0] and v[1] != v[0] for v in got.values())


def test_word_counts_match_brute_force(spark):
    from lectern.llm.spelling import spelling_variants, word_counts

    r = random.Random(9)
    vocabulary = ["".join(r.choice("abcdeÀéßXYZ") for _ in range(r.randrange(5, 12))) for _ in range(120)]
    rows = [(i, r.choice([" ", "-", "9", "_"]).join(r.choice(vocabulary) for _ in range(60)), "en", "s") for i in range(40)]
    rows += [(None, "wordless " * 5, "en", "s"), (7, None, "en", "s"), (8, "", "en", "s"), (9, "ab12345678 " * 3 + "Ω" * 9, "en", "s"), (10, "é" * 9_000 + " " + "é" * 9_000, "en", "s"), rows[0]]
    docs = edge.documents(spark, rows)
    want = brute_counts([x[:2] for x in rows])
    assert {x.word: x.n for x in word_counts(docs).collect()} == want
    assert {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in spelling_variants(word_counts(docs)).collect()} == brute_variants(want)
    assert spelling_variants(word_counts(edge.documents(spark, []))).collect() == []
