"""Byte-level BPE: encoding by merge replay over a corpus of distinct words, and decoding."""

from __future__ import annotations

import base64
import bisect
import gc
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lectern.llm.common import small_batches, tidy

#: Words whose ids a Python worker keeps during a task; more or fewer change only speed.
CACHE_WORDS = 300_000
#: Characters of text whose distinct words are looked up together, and distinct words in one replay,
#: so few that their symbols stay in the processor's cache.
BATCH_CHARS = 1_000_000
REPLAY_WORDS = 400

OUT = "n_tokens long, ids array<int>"


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file with a base64 token and a rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Merges:
    """A rank file's tables: the rank of each byte, and of each pair of tokens that join to a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {r: b for b, r in ranks.items()}
        self.byte = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)
        self.pair = {}
        for word, r in ranks.items():
            for i in range(1, len(word)):
                left, right = ranks.get(word[:i]), ranks.get(word[i:])
                if left is not None and right is not None:
                    self.pair[left << 32 | right] = r
        self.bytes2 = np.array([[ranks.get(bytes([i, j]), -1) for j in range(256)] for i in range(256)], np.int64)


def replay(words: list[bytes], merges: Merges) -> list[tuple[int, ...]]:
    """Token ids of each word by replaying merges in rank order over all words at once.

    All words lie in one array of symbols with links to the neighbours. An inverted index leads from
    the rank of a pair to the positions where it stands; a heap gives the lowest rank still present.
    A merge touches only its two neighbours, whose new pairs enter the index. When a merge makes a
    pair of a lower rank, the later positions in that word wait until the lower one is done, so every
    word sees its merges in the order in which it would see them alone. A word that is a token is
    that token, whatever its merges give. An empty word gives no ids; a byte without a rank raises
    KeyError.
    """
    ranks = merges.ranks
    out: list = [None] * len(words)
    todo = []
    for w, word in enumerate(words):
        r = ranks.get(word)
        if r is not None:
            out[w] = (r,)
        elif word:
            todo.append(w)
        else:
            out[w] = ()
    if not todo:
        return out
    sizes = np.fromiter((len(words[w]) for w in todo), np.int64, len(todo))
    buf = np.frombuffer(b"".join([words[w] for w in todo]), np.uint8)
    first = merges.byte[buf]
    if (first < 0).any():
        raise KeyError("a byte has no rank")
    ends = np.cumsum(sizes)
    n = len(buf)
    nxt, prev, standing = np.arange(1, n + 1), np.arange(-1, n - 1), np.full(n, -1)
    standing[:-1] = merges.bytes2[buf[:-1], buf[1:]]
    nxt[ends - 1] = prev[ends - sizes] = standing[ends - 1] = -1
    order = np.argsort(standing, kind="stable")
    present, at = np.unique(standing[order], return_index=True)
    index: dict[int, list[int]] = {r: x.tolist() for r, x in zip(present.tolist(), np.split(order, at[1:]), strict=True) if r >= 0}
    heap = sorted(index)
    sym, nxt, prev, standing, stops = first.tolist(), nxt.tolist(), prev.tolist(), standing.tolist(), ends.tolist()
    get, push, pop = merges.pair.get, heapq.heappush, heapq.heappop
    while heap:
        rank = pop(heap)
        places = index.pop(rank)
        places.sort()
        wait, later, high = -1, [], rank << 32
        for p in places:
            if standing[p] != rank:
                continue
            if p < wait:
                later.append(p)
                continue
            q = nxt[p]
            after = nxt[q]
            sym[p], sym[q], nxt[p], standing[q] = rank, -1, after, -1
            lower = False
            if after >= 0:
                prev[after] = p
                r = get(high | sym[after], -1)
                standing[p] = r
                if r >= 0:
                    if r in index:
                        index[r].append(p)
                    else:
                        index[r] = [p]
                        push(heap, r)
                    lower = r < rank
            else:
                standing[p] = -1
            before = prev[p]
            if before >= 0:
                r = get(sym[before] << 32 | rank, -1)
                standing[before] = r
                if r >= 0:
                    if r in index:
                        index[r].append(before)
                    else:
                        index[r] = [before]
                        push(heap, r)
                    lower = lower or r < rank
            if lower:
                wait = stops[bisect.bisect_right(stops, p)]
        if later:
            push(heap, rank)
            index[rank] = later
    final = np.array(sym)
    alive = final >= 0
    cut = np.concatenate(([0], np.cumsum(alive)[ends - 1])).tolist()
    ids = final[alive].tolist()
    for w, a, z in zip(todo, cut, cut[1:], strict=False):
        out[w] = tuple(ids[a:z])
    return out


class Encoder:
    """Encodes batches of texts; remembers words of earlier ones in two generations.

    Words are looked up in the young generation, then in the old one, from which they move to the young.
    When the young one is full it becomes the old one. So words that keep coming stay.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, digests: bool = False):
        self.merges, self.find, self.digests = Merges(ranks), regex.compile(pattern).findall, digests
        self.decimal = {r: str(r) for r in ranks.values()}
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def split(self, texts: list) -> list[list[str]]:
        return [self.find(t) if t else [] for t in texts]

    def learn(self, pieces: list[list[str]]) -> dict:
        """Ids of every distinct word of the pieces, and of others; for digests with their number, the
        decimal ids and what they decode to."""
        if len(self.young) > CACHE_WORDS // 2:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        new = []
        for w in set().union(*pieces):
            if w not in young:
                v = old.get(w)
                if v is None:
                    new.append(w)
                else:
                    young[w] = v
        gc.disable()  # nothing here forms cycles, and the many small tuples make collections slow
        try:
            for a in range(0, len(new), REPLAY_WORDS):
                part = new[a : a + REPLAY_WORDS]
                made = replay([w.encode() for w in part], self.merges)
                if self.digests:
                    made = [(v, len(v), " ".join(map(self.decimal.__getitem__, v)), self.decode(v)) for v in made]
                young.update(zip(part, made, strict=True))
        finally:
            gc.enable()
        return young

    def rest(self) -> None:
        """Between tasks: forget all words, so that an idle worker holds the merges only."""
        self.young, self.old = {}, {}

    def decode(self, ids) -> bytes:
        return b"".join(map(self.merges.token.__getitem__, ids))


def _slices(texts: list):
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= BATCH_CHARS:
            yield texts[start : i + 1], start
            start, total = i + 1, 0
    if start < len(texts):
        yield texts[start:], start


_ENCODERS: dict = {}


def _encoder(path: str, pattern: str, digests: bool) -> Encoder:
    """One encoder for each vocabulary file in a Python worker; tasks that follow reuse it."""
    key = (path, pattern, digests)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(load_ranks(path), pattern, digests)
    return _ENCODERS[key]


def encode_documents(docs: DataFrame, path: str, pattern: str, keep: list[str], text: str = "text", ids: bool = True, digests: bool = False) -> DataFrame:
    """Columns `keep`, n_tokens, and as asked ids (array of int) or digests of ids and decoded bytes.

    path: a rank file that every executor has; pattern: what splits a text before the merges. No
    special tokens: their strings count as text. A null text counts as empty: no tokens. Rows are
    independent, so nothing is shuffled; a task holds BATCH_CHARS characters at a time, or one text.
    ids_sha256 is of the decimal ids joined by one space, decoded_sha256 of the bytes that decoding
    the ids gives, both in lower-case hex. Other columns are dropped, so their names can't clash.
    """
    small_batches(docs)
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["n_tokens long"]
    fields += ["ids array<int>"] * ids + ["ids_sha256 string", "decoded_sha256 string"] * digests

    def run(batches):
        enc = _encoder(path, pattern, digests)
        enc.rest()
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            for part, start in _slices(texts):
                pieces = enc.split(part)
                of = enc.learn(pieces)
                cols = [batch.column(i).slice(start, len(part)) for i in range(len(keep))]
                if digests:
                    made = [[of[w] for w in p] for p in pieces]
                    cols.append(pa.array([sum([m[1] for m in x]) for x in made], pa.int64()))
                    flat = [[i for m in x for i in m[0]] for x in made] if ids else None
                else:
                    flat = [[i for w in p for i in of[w]] for p in pieces]
                    cols.append(pa.array([len(x) for x in flat], pa.int64()))
                if ids:
                    cols.append(pa.array(flat, pa.list_(pa.int32())))
                if digests:
                    cols.append(pa.array([hashlib.sha256(" ".join([m[2] for m in x if m[1]]).encode()).hexdigest() for x in made], pa.string()))
                    cols.append(pa.array([hashlib.sha256(b"".join([m[3] for m in x])).hexdigest() for x in made], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=[f.split(" ")[0].strip("`") for f in fields])
        enc.rest()

    return docs.select(*[f"`{c}`" for c in keep], f"`{text}`").mapInArrow(tidy(run), ", ".join(fields))


def decode_ids(df: DataFrame, path: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """Columns `keep` and bytes, what the ids stand for; null ids give null, unknown ones KeyError."""
    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + ["bytes binary"]

    def run(batches):
        token = {r: b for b, r in load_ranks(path).items()}
        for batch in batches:
            made = [None if v is None else b"".join(token[i] for i in v) for v in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(made, pa.binary())], names=[*keep, "bytes"])

    return df.select(*[f"`{c}`" for c in keep], f"`{ids}`").mapInArrow(run, ", ".join(fields))
