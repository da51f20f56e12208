"""Excerpts of a length: paragraphs from near the beginning, and sentences of the one that doesn't fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.paragraphs import bound, paragraphs, running_sums, word_count
from lectern.functions.sentences import split_at_marks
from lectern.operators.cuts import computed

# fixed values: least, most and target words of an excerpt; paragraphs that may be left out before it
LENGTHS = {"short": (250, 499, 360), "medium": (500, 800, 620), "long": (801, 1200, 960)}
STARTS = 3


def _base(ps: Column, start: int) -> Column:
    return F.when(F.lit(start) > 0, F.get(ps, F.lit(start - 1))["upto"]).otherwise(F.lit(0).cast("bigint"))


def _fits(ps: Column, start: int, most: int) -> Column:
    """Paragraphs from `start` on that fit in `most` words."""
    return F.filter(F.slice(ps, start + 1, F.greatest(F.size(ps) - start, F.lit(0))), lambda p: p["upto"] - _base(ps, start) <= most)


def _of(ps: Column, sums: Column, start: int, least: int, most: int, target: int) -> Column:
    """(off, words, pieces, whole, sentences) of the best excerpt from paragraph `start` (from 0) of structs (text, words, upto): null if none;
    sums: (i, upto) of each paragraph that may be cut, its running words by sentence.

    Paragraphs are taken while they fit in `most` words, and then sentences of the next; of the lengths of
    `least` words or more on the way the nearest to target wins, then the one of fewer pieces.
    """
    base = _base(ps, start)

    def ranked(words: Column, pieces: Column, whole: Column, sentences: Column) -> Column:
        return F.struct(F.abs(words - target).cast("long").alias("off"), pieces.cast("int").alias("pieces"), words.cast("long").alias("words"), whole.cast("int").alias("whole"), sentences.cast("int").alias("sentences"))

    def chosen(fit):
        n = F.size(fit)
        taken = F.when(n > 0, F.element_at(fit, -1)["upto"] - base).otherwise(F.lit(0).cast("bigint"))
        whole = F.transform(fit, lambda p, i: ranked(p["upto"] - base, i + 1, i + 1, F.lit(0)))
        rest = F.filter(sums, lambda x: x["i"] == n + start)[0]["upto"]
        more = bound(rest, lambda r: F.transform(r, lambda w, k: ranked(taken + w, n + k + 1, n, k + 1)))
        good = F.filter(F.concat(whole, more), lambda x: (x["words"] >= least) & (x["words"] <= most))
        return F.array_min(good)

    return F.when(F.size(ps) > start, bound(_fits(ps, start, most), chosen))


def excerpts(docs: DataFrame, lengths: dict[str, tuple[int, int, int]] | None = None) -> DataFrame:
    """doc_id, bucket, start, words, pieces, excerpt: the best excerpt of each text for each length that it can give.

    Excerpts may begin at the first STARTS paragraphs; of these the nearest to the target wins, then the
    earliest. Pieces are parted by empty lines. Texts that are null, empty or too short give no rows.
    """
    d = computed(docs.select("doc_id", "text"), q=paragraphs(F.col("text"))).drop("text")
    d = computed(d, w=F.transform("q", lambda p: word_count(p)))
    d = computed(d, u=running_sums(F.col("w")))
    d = computed(d, ps=F.transform(F.arrays_zip("q", "w", "u"), lambda x: F.struct(x["q"].alias("text"), x["w"].alias("words"), x["u"].alias("upto")))).select("doc_id", "ps")

    # paragraphs that some excerpt would cut, each split once
    cut = F.array_distinct(F.array(*[F.size(_fits(F.col("ps"), s, most)) + s for s in range(STARTS) for _, most, _ in (lengths or LENGTHS).values()]))
    d = computed(d, sums=F.transform(cut, lambda i: F.struct(i.alias("i"), running_sums(F.transform(split_at_marks(F.coalesce(F.get("ps", i)["text"], F.lit(""))), word_count)).alias("upto"))))

    def started(start: int, least: int, most: int, target: int) -> Column:
        def of(b):
            return F.when(b.isNotNull(), F.struct(b["off"].alias("off"), F.lit(start).alias("start"), b.alias("b")))

        return bound(_of(F.col("ps"), F.col("sums"), start, least, most, target), of)

    def named(bucket: str, limits: tuple[int, int, int]) -> Column:
        def of(x):
            return F.when(x.isNotNull(), F.struct(F.lit(bucket).alias("bucket"), x["start"].alias("start"), x["b"].alias("b")))

        return bound(F.array_min(F.array(*[started(s, *limits) for s in range(STARTS)])), of)

    found = [named(k, v) for k, v in (lengths or LENGTHS).items()]
    d = computed(d, found=F.filter(F.array(*found), lambda x: x.isNotNull())).select("doc_id", "ps", F.explode("found").alias("x"))
    whole = F.transform(F.slice("ps", F.col("x.start") + 1, F.col("x.b.whole")), lambda p: p["text"])
    following = F.coalesce(F.get("ps", F.col("x.start") + F.col("x.b.whole"))["text"], F.lit(""))
    text = F.array_join(F.concat(whole, F.slice(split_at_marks(following), 1, F.col("x.b.sentences"))), "\n\n")
    return d.select("doc_id", "x.bucket", "x.start", F.col("x.b.words").alias("words"), F.col("x.b.pieces").alias("pieces"), text.alias("excerpt"))
