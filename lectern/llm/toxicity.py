"""Toxicity by nearest labelled examples by cosine, computed exactly, of TF-IDF weights with label words lifted, from an inverted index with block maxima."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import drop_spill, small_batches, spill, tidy

#: Most labelled rows that are learnt from (those with the least hash), examples that a block of the
#: index holds, and neighbours that vote.
SAMPLE, BLOCK, NEIGHBOURS = 6_000, 64, 15
#: Lengths of word beginnings, which are terms beside all words where they go with label 1.
PREFIXES = (3, 4, 5, 6, 7)
#: Terms that go with label 1 count this many times; all others count once.
LIFT = 8.0
#: Such terms that chance alone would admit (the number tested times the binomial chance of a term's
#: labels), examples that one must occur in, weight of the base rate in votes.
CHANCE, SUPPORT, PRIOR = 0.5, 3, 0.1
#: A term in more than one of so many examples has a row of the dense table instead of a postings list.
DENSE = 16
#: Words whose terms a worker remembers; more or fewer change only speed.
KNOWN = 100_000
#: Most frequent terms by whose presence examples are put in order.
ORDERED_BY = 24

_WORDS = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[str]:
    """A word and its beginnings, marked with a star, for words that differ only in their endings."""
    return [word] + [word[:k] + "*" for k in PREFIXES if len(word) > k]


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters of the whole text; none for null."""
    return _WORDS.findall(text.lower()) if text else []


class Index:
    """The examples' unit vectors by term, with bounds for blocks of BLOCK examples.

    Rare terms have postings lists. Terms of more than 1 / DENSE of the examples have a row of a table,
    at most DENSE times the examples' mean number of terms, with their maximum in each block.
    """

    def __init__(self, ids: list[int], labels: list[int], vectors: list[dict[int, float]], terms: int):
        self.ids, self.labels = np.array(ids, np.int64), np.array(labels, np.int64)
        n = len(ids)
        self.blocks, self.looked = -(-n // BLOCK), 0
        term = np.fromiter((t for v in vectors for t in v), np.int64)
        weight = np.fromiter((w for v in vectors for w in v.values()), np.float64)
        owner = np.repeat(np.arange(n), [len(v) for v in vectors])
        order = np.argsort(term, kind="stable")
        term, weight, owner = term[order], weight[order], owner[order]
        df = np.bincount(term, minlength=terms)
        many = df * DENSE > n
        self.row = np.where(many, np.cumsum(many) - 1, -1).astype(np.int32)
        self.dense = np.zeros((int(many.sum()), self.blocks, BLOCK), np.float32)
        d = many[term]
        self.dense[self.row[term[d]], owner[d] // BLOCK, owner[d] % BLOCK] = weight[d]
        self.most = self.dense.max(2) if n else np.zeros((0, 0), np.float32)
        self.norm = np.sqrt((self.dense.astype(np.float64) ** 2).sum(0)).max(1) if n else np.zeros(0)
        df[many] = 0
        self.start = np.concatenate(([0], np.cumsum(df)))
        self.at, self.weight = owner[~d].astype(np.int32), weight[~d].astype(np.float32)

    def nearest(self, vector: dict[int, float], k: int, without: int | None = None) -> list[tuple[float, int]]:
        """The k examples of greatest positive cosine with a unit vector, and their places; ties by id.

        Postings of the rare terms give each example a part of its cosine, so the k-th part is a lower
        bound of the k-th cosine. Blocks whose greatest part plus the bound of the dense terms (by their
        block maxima, or by the block's greatest norm over them) is below it are passed over.
        """
        n = len(self.ids)
        if not vector or not n:
            return []
        terms, q = np.fromiter(vector, np.int64, len(vector)), np.fromiter(vector.values(), np.float64, len(vector))
        row = self.row[terms]
        rare = row < 0
        start, size = self.start[terms[rare]], self.start[terms[rare] + 1] - self.start[terms[rare]]
        first = np.cumsum(size) - size
        at = np.arange(int(size.sum())) + np.repeat(start - first, size)
        part = np.bincount(self.at[at], self.weight[at] * np.repeat(q[rare], size), self.blocks * BLOCK)
        row, q = row[~rare], q[~rare]
        if len(row):
            bound = np.minimum(q @ self.most[row], np.sqrt(q @ q) * self.norm)
            least = np.partition(part, -k - 1)[-k - 1] if n > k else 0.0  # one more, should one be left out
            blocks = np.flatnonzero(part.reshape(-1, BLOCK).max(1) + bound >= least - 1e-6)
            rest = q.astype(np.float32) @ self.dense[row[:, None], blocks[None, :]].reshape(len(row), -1)
            places = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            score = part[places] + rest
            self.looked += len(blocks)
        else:
            places = np.flatnonzero(part)
            score = part[places]
        fine = (score > 1e-9) & (places < n)
        if without is not None:
            fine[fine] &= self.ids[places[fine]] != without
        places, score = places[fine], np.round(score[fine], 6)
        if len(places) > k:
            keep = score >= np.partition(score, -k)[-k]
            places, score = places[keep], score[keep]
        best = np.lexsort((self.ids[places], -score))[:k]
        return list(zip(score[best].tolist(), places[best].tolist(), strict=True))


class Model:
    """Terms, their IDF, the index of examples, the base rate and the calibration, from labelled word counts."""

    def __init__(self, rows: list[tuple[int, dict[str, int], int]]):
        rows = sorted(rows, key=lambda r: r[0])
        self.base = (sum(y for _, _, y in rows) + 0.5) / (len(rows) + 1)
        self.slope, self.shift = 1.0, 0.0
        self.known: dict[str, tuple[int, ...]] = {}
        n, pos = len(rows), sum(y for _, _, y in rows)
        df, hits = Counter(), Counter()
        for _, words, y in rows:
            own = {f for w in words for f in features_of(w)}
            df.update(own)
            if y:
                hits.update(own)
        lifted = set()
        rate = pos / n if n else 0.0
        for f, d in df.items():
            a = hits[f]
            if d < SUPPORT or not 0 < rate < 1 or a <= d * rate:
                continue
            chance = math.lgamma(d + 1) - math.lgamma(a + 1) - math.lgamma(d - a + 1) + a * math.log(rate) + (d - a) * math.log(1 - rate)
            if chance + math.log(len(df)) <= math.log(CHANCE):
                lifted.add(f)
        self.starts = {f for f in lifted if f.endswith("*")}
        self.terms = {f: i for i, f in enumerate(f for f in df if not f.endswith("*") or f in lifted)}
        self.weight = np.array([(math.log((1 + n) / (1 + df[f])) + 1) * (LIFT if f in lifted else 1.0) for f in self.terms])
        self.unseen = math.log(1 + n) + 1
        vectors = [self.vector(words) for _, words, _ in rows]
        # examples that hold the same frequent words stand together, which tells a block's maxima from others'
        often = [self.terms[f] for f, _ in sorted(((f, d) for f, d in df.items() if f in self.terms), key=lambda x: (-x[1], x[0]))[:ORDERED_BY]]
        some = sorted((i for i, v in enumerate(vectors) if v), key=lambda i: [t not in vectors[i] for t in often])
        self.known.clear()
        self.index = Index([rows[i][0] for i in some], [rows[i][2] for i in some], [vectors[i] for i in some], len(self.terms))

    def terms_of(self, word: str) -> tuple[int, ...]:
        """A word's term, -1 if no example has it, and those of its beginnings."""
        starts = [word[:k] + "*" for k in PREFIXES if len(word) > k]
        return (self.terms.get(word, -1), *[self.terms[x] for x in starts if x in self.starts])

    def vector(self, words: dict[str, int]) -> dict[int, float]:
        """Weights (1 + ln tf) * idf, times LIFT for lifted terms, of the unit vector of all words.

        Words that no example has can't meet one, but count in the length of the vector.
        """
        known, found, rest = self.known, {}, 0.0
        if len(known) > KNOWN:
            known.clear()
        for w, n in words.items():
            of = known.get(w)
            if of is None:
                of = known[w] = self.terms_of(w)
            for t in of:
                if t < 0:
                    rest += (1 + math.log(n)) ** 2
                elif t in found:
                    found[t] += n
                else:
                    found[t] = n
        at = np.fromiter(found, np.int64, len(found))
        x = (1 + np.log(np.fromiter(found.values(), np.float64, len(found)))) * self.weight[at]
        x /= math.sqrt(float(x @ x) + rest * self.unseen**2) or 1.0
        return dict(zip(found, x.tolist(), strict=True))

    def vote(self, words: dict[str, int], without: int | None = None) -> tuple[float, list[int]]:
        """Votes of the nearest examples weighted by squared cosine, with the base rate's; and their ids."""
        near = self.index.nearest(self.vector(words), NEIGHBOURS, without)
        weights = [s * s for s, _ in near]
        votes = sum(w * int(self.index.labels[i]) for w, (_, i) in zip(weights, near, strict=True))
        return (votes + PRIOR * self.base) / (sum(weights) + PRIOR), [int(self.index.ids[i]) for _, i in near[:3]]

    def score(self, words: dict[str, int]) -> tuple[float, list[int]]:
        """The calibrated vote, and the ids of the three nearest examples."""
        v, near = self.vote(words)
        return 1 / (1 + math.exp(-(self.slope * _odds(v) + self.shift))), near

    def calibrate(self, votes: np.ndarray, labels: np.ndarray) -> None:
        """Slope and shift of the votes' log-odds by logistic regression (Platt scaling), from votes that
        each example got without itself. With labels of one kind the votes stay as they are."""
        if not 0 < labels.sum() < len(labels):
            return
        z = np.stack([[_odds(v) for v in votes], np.ones(len(votes))], 1)
        w = np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (p - labels) + 1e-3 * (w - [1.0, 0.0]))
            w -= np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        self.slope, self.shift = max(0.05, float(w[0])), float(w[1])


def _odds(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def held_out(doc_id) -> F.Column:
    """Whether crc32 of the id as text is divisible by 5: never learnt from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def _counted(batches):
    for b in batches:
        for i in range(len(b)):
            c = Counter(words_of(b.column(1)[i].as_py()))
            made = [b.column(0).slice(i, 1), pa.array([list(c.items())], pa.map_(pa.string(), pa.int32())), b.column(2).slice(i, 1)]
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "words", "toxic"])


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from SAMPLE labelled rows at most, those with the least hash of doc_id.

    Rows with a null id or label, or that are held out, teach nothing; a doc_id that repeats in
    labels counts once with its greatest label, one that repeats in docs with all its texts' words. The
    texts are counted and the votes for the calibration taken by Spark; the driver sees word counts.
    """
    y = labels.where("doc_id is not null and toxic is not null").where(~held_out("doc_id"))
    y = y.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(y), "doc_id").select("doc_id", "text", "toxic")
    counted = spill(rows.mapInArrow(tidy(_counted), "doc_id long, words map<string,int>, toxic int").repartition("doc_id"))
    known: dict[int, tuple[Counter, int]] = {}
    for r in counted.toLocalIterator():
        known.setdefault(r.doc_id, (Counter(), int(r.toxic > 0)))[0].update(r.words)
    model = Model([(i, dict(sorted(words.items())), y) for i, (words, y) in known.items()])
    if len(known) > 1:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def alone(batches):
            for b in batches:
                votes = [shared.value.vote(dict(w), i)[0] for i, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(votes, pa.float64()), b.column(2)], names=["doc_id", "vote", "toxic"])

        votes = sorted(tuple(r) for r in counted.mapInArrow(tidy(alone), "doc_id long, vote double, toxic int").collect())
        model.calibrate(np.array([v for _, v, _ in votes]), np.array([float(t > 0) for _, _, t in votes]))
        shared.destroy()
    drop_spill(counted)
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from 0.5), evidence (ids of the nearest examples).

    Examples are labelled documents (a bounded sample, broadcast: SAMPLE rows with all their words). Every
    word is a term; words and word beginnings that go with label 1 beyond chance weigh LIFT times. Of
    each document the NEIGHBOURS examples of greatest cosine (TF-IDF, words that go with label 1 times LIFT) vote with their squared
    cosine, and the base rate with weight PRIOR; the vote is calibrated on the examples' own votes, each
    taken without itself. Inputs of a score are texts alone.

    Null and empty texts have no neighbours and score the calibrated base rate; null doc_ids give null
    held_out; repeated rows are scored each; without labels all score 0.5. Other columns are ignored;
    no rows give no rows.
    """
    small_batches(docs)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(learn(docs, labels))

    def run(batches):
        model = shared.value
        for batch in batches:
            made = [model.score(Counter(words_of(t.as_py()))) for t in batch.column(2)]
            cols = [batch.column(0), batch.column(1), pa.array([s for s, _ in made], pa.float64()), pa.array([int(s >= 0.5) for s, _ in made], pa.int32()), pa.array([e for _, e in made], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "score", "predicted", "evidence"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), "text")
    return rows.mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, predicted int, evidence array<long>")
