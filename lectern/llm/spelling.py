"""Spelling variants: words one edit apart, found by their rarest positional bigrams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import drop_spill, mix64, seeds, spill, tidy

#: One edit changes two bigrams at most, so two words one edit apart share one of the three rarest of each.
RARE = 3
#: Bigrams are counted in so many bits' worth of buckets.
BUCKET_BITS = 16
#: Words that one task makes keys of, some 40 each.
WORDS = 20_000

_SPREAD, _BASE = seeds(2, 13)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, least_length: int = 7, least_count: int = 2, typo_every: int | None = 31) -> DataFrame:
    """word, n: the words of all texts with at least least_length code points and least_count occurrences.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case. Where the CRC-32 of
    "<doc_id>:<word>" is divisible by typo_every, the word loses its code point at CRC modulo length
    first; None leaves words alone. Null texts have no words; a null doc_id counts as empty.
    """
    runs = F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-zÀ-ÿ]{{{least_length},}}"), F.lit(0)))
    w = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("i"), runs.alias("w"))
    w = w.select("i", F.translate("w", _UPPER, _LOWER).alias("w"))
    if typo_every:
        w = w.select("w", F.crc32(F.concat_ws(":", "i", "w").cast("binary")).alias("h"))
        cut = F.expr("concat(left(w, cast(h % length(w) as int)), substring(w, cast(h % length(w) as int) + 2))")
        w = w.select(F.when(F.col("h") % typo_every == 0, cut).otherwise(F.col("w")).alias("w")).where(F.length("w") >= least_length)
    return w.groupBy(F.col("w").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _latin(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, length).astype(np.uint64)


def _gram_codes(codes: np.ndarray) -> np.ndarray:
    return codes[:, :-1] << np.uint64(21) | codes[:, 1:]


def _bucket(grams: np.ndarray) -> np.ndarray:
    return (mix64(grams * _SPREAD) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _by_length(words: list[str]):
    """Places and code points of the words of each length that is enough for RARE bigrams."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(sizes[sizes > RARE]).tolist():
        at = np.flatnonzero(sizes == length)
        for i in range(0, len(at), max(1, 2_000_000 // length)):
            part = at[i : i + max(1, 2_000_000 // length)]
            yield part, _latin([words[j] for j in part.tolist()], length)


def _count_grams(batches):
    """bucket, df of a task: how many words hold a bigram of each bucket."""
    total = np.zeros(1 << BUCKET_BITS, np.int64)
    for batch in batches:
        for _, codes in _by_length(batch.column(0).to_pylist()):
            b = np.sort(_bucket(_gram_codes(codes)), 1)
            new = np.concatenate((np.ones((len(b), 1), bool), b[:, 1:] != b[:, :-1]), 1)
            total += np.bincount(b[new], minlength=len(total))
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "df"])


def _keys(codes: np.ndarray, rank: np.ndarray, longer: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of codes and join keys of words of one length, as the shorter or equal, or as the longer word of a pair.

    A shared bigram stands at p of the shorter word, whose length is l. The edit is left or right of it,
    and of the longer of these two parts in its first or second half: three cases, in each of which all the
    rest is the same in both words. A key holds the case, l, p, the bigram and hashes of that rest.
    """
    n, size = codes.shape
    grams = _gram_codes(codes)
    order = np.argsort(rank[_bucket(grams)].astype(np.uint64) << np.uint64(42) | grams, axis=1, kind="stable")[:, :RARE]
    with np.errstate(over="ignore"):
        letters = mix64(codes + np.uint64(1))
        prefix, power = np.zeros((n, size + 1), np.uint64), np.ones(size + 1, np.uint64)
        for i in range(size):
            prefix[:, i + 1] = prefix[:, i] * _BASE + letters[:, i]
            power[i + 1] = power[i] * _BASE
        row = np.arange(n)
        out_rows, out = [], []

        def piece(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            return prefix[row, hi] - prefix[row, lo] * power[hi - lo]

        for g in range(RARE):
            q = order[:, g]
            gram = grams[row, q]
            for pair in ("insert",) if longer else ("insert", "replace"):
                l = size - 1 if longer else size
                for left_edit in (True, False):
                    p = q - 1 if longer and left_edit else q
                    left, right = p, l - p - 2
                    fits = (p >= 0) & (right >= 0)
                    wide = left if left_edit else right
                    split = left >= right if left_edit else right > left
                    half = wide // 2
                    kept = piece(np.minimum(q + 2, size), np.full(n, size)) if left_edit else piece(np.zeros(n, np.int64), q)
                    # the edited part is [start, stop): its first half is the same, or its last wide - half
                    start, stop = (np.zeros(n, np.int64), q) if left_edit else (np.minimum(q + 2, size), np.full(n, size))
                    half, rest = np.where(fits & split, half, 0), np.where(fits & split, wide - half, 0)
                    for case, ok, same in (
                        (0, fits & ~split & ((wide > 0) | (pair == "insert")), None),
                        (1, fits & split & (half > 0), (stop - rest, stop)),
                        (2, fits & split, (start, start + half)),
                    ):
                        if not ok.any():
                            continue
                        key = gram * _SPREAD + np.uint64(case + 4 * left_edit + 8 * (pair == "insert"))
                        key = mix64(key) + (p.astype(np.uint64) << np.uint64(32)) + np.uint64(l)
                        key = mix64(key) * _BASE + kept
                        if same is not None:
                            key = mix64(key) * _BASE + piece(np.where(ok, same[0], 0), np.where(ok, same[1], 0))
                        out_rows.append(row[ok])
                        out.append(mix64(key[ok]))
    return np.concatenate(out_rows), np.concatenate(out).view(np.int64)


def _keyed(rank: np.ndarray, longer: tuple[bool, ...]):
    """A function for mapInArrow over words: key, word."""

    def run(batches):
        for batch in batches:
            words = batch.column(0)
            for part, codes in _by_length(words.to_pylist()):
                for long in longer:
                    rows, keys = _keys(codes, rank, long)
                    for i in range(0, len(rows), 100_000):
                        yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 100_000]), words.take(pa.array(part[rows[i : i + 100_000]]))], names=["key", "word"])

    return run


def near_words(words: DataFrame) -> DataFrame:
    """a, b: pairs of distinct words, both ways, that differ by exactly one inserted, deleted or replaced code point.

    Bigrams are ordered by how many words hold them, the rarest first (counted in 2^BUCKET_BITS buckets,
    so that the table that tasks get is of bounded size; ties by bucket and bigram), and a word is known by
    its first RARE, earlier positions first. One edit changes two bigrams at most, so one of these three
    stands in the other word too, among its first three, moved by the edit only: at the same position, or
    in the longer word at the next one. Words join under these bigrams, their limited positions, and what
    the edit can't have changed (`_keys`); pairs are verified by their edit distance. Exact.

    Words of RARE code points or fewer have too few bigrams and must not be asked for.
    """
    words = words.select("word")
    words = words.repartition(max(1, -(-words.count() // WORDS)), "word")
    df = words.mapInArrow(tidy(_count_grams), "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df"))
    often = np.zeros(1 << BUCKET_BITS, np.int64)
    for r in df.toLocalIterator():  # 2^BUCKET_BITS rows at most
        often[r["bucket"]] = r["df"]
    rank = np.empty(len(often), np.int32)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often), dtype=np.int32)
    short = words.mapInArrow(tidy(_keyed(rank, (False,))), "key long, word string").withColumnRenamed("word", "a")
    other = words.mapInArrow(tidy(_keyed(rank, (False, True))), "key long, word string").withColumnRenamed("word", "b")
    met = short.join(other, "key").where("(length(a) < length(b) or length(a) = length(b) and a < b) and levenshtein(a, b, 1) = 1")
    found = spill(met.select("a", "b").distinct())
    return found.unionAll(found.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of words with a form: the last of the chain of forms, by doubling the steps."""
    at = spill(forms.select("word", F.col("form").alias("root")))
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("on"))
        ahead = spill(at.join(step, "root", "left").select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")))
        drop_spill(at)
        at = ahead
        if not at.where("moved").limit(1).count():
            return at.select("word", "root")


def spelling_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of counted words (word, n).

    Words are near if they differ by one inserted, deleted or replaced code point (`near_words`, exact).
    A word's form is its near word of largest n, ties to the first in code-point order, if that n is at
    least ratio times the word's own, else null; root follows forms to the last one, the word itself if
    it has none; n_near counts near words. A form's n grows by the ratio each time, so chains are short.

    Null words are dropped and rows that repeat a word add up; words under RARE + 1 code points are near
    nothing. Other columns are ignored; no rows give no rows.
    """
    words = spill(words.where("word is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n")))
    near = near_words(words.where(F.length("word") > RARE))
    near = near.join(words.select(F.col("word").alias("b"), "n"), "b")
    best = near.groupBy("a").agg(F.min(F.struct((-F.col("n")).alias("m"), "b")).alias("best"), F.count("*").alias("n_near"))
    best = best.select(F.col("a").alias("word"), "n_near", F.col("best.b").alias("b"), (-F.col("best.m")).alias("m"))
    joined = words.join(best, "word", "left").withColumn("fits", F.coalesce(F.col("m") >= ratio * F.col("n"), F.lit(False)))
    joined = spill(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("fits"), F.col("b")).alias("form"), F.when(F.col("fits"), F.col("m")).alias("form_n")))
    roots = _roots(joined.where("form is not null"))
    return joined.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
