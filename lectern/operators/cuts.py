"""Reading segments: where a text is cut, by topic boundaries, headings and word counts. Native throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.paragraphs import REFERENCE_TITLE, bound, content_sentences, marked_sentences, running_sums
from lectern.operators.sequences import spread, written

# fixed values: aim and limits of a segment in words, sentences of a block, words before an early cut at a
# heading, least words on both sides of a cut at the second of two headings, strengths of headings
TARGET, LEAST, MOST, BLOCK, EARLY, SIDE, MAJOR, MINOR = 650, 450, 850, 4, 180, 250, 1.5, 1.2
# fixed values: headings that count as major at any level
MAJOR_TITLES = ("introduction", "conclusion", "final thoughts", "summary")

_TITLE = r"^(?:#{1,6} )?(?:\d+(?:\.\d+)*\.? )?[ :-]*(.*?)[ :-]*$"


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once for each row, whatever later filters and lambdas use of them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def is_major(s: Column) -> Column:
    """Whether a marked sentence is a heading of level 1 or 2 or of a well-known section."""
    return s["heading"] & ~s["reference"] & (s["level"].isin(1, 2) | F.lower(F.regexp_extract(s["text"], _TITLE, 1)).isin(*MAJOR_TITLES))


def block_strengths(rows: DataFrame) -> DataFrame:
    """key, strengths: for each row (key, s) how much each block of BLOCK sentences differs from the next.

    1 - cosine of the blocks' TF-IDF vectors, rounded to 6 places, with document frequencies over the row's
    own blocks: ln((1 + blocks) / (1 + df)) + 1. Terms are counted in one exchange; document frequency and
    the meeting of neighbouring blocks are one window over a row's term; sums over a block give the rest.
    """
    some = F.ceil(F.size("s") / BLOCK).cast("int")
    sentence = rows.select("key", some.alias("blocks"), F.posexplode("s").alias("i", "x"))
    term = F.explode(F.regexp_extract_all(F.lower("x.text"), F.lit("([a-z][a-z'-]*)"), F.lit(1)))
    tf = sentence.select("key", "blocks", F.expr(f"i div {BLOCK}").cast("int").alias("block"), term.alias("t")).groupBy("key", "blocks", "block", F.xxhash64("t").alias("term")).agg(F.count("*").alias("tf"))
    w = Window.partitionBy("key", "term")
    along = w.orderBy("block")
    idf = F.log((1 + F.col("blocks")) / (1 + F.count("*").over(w).cast("double"))) + 1
    tf = tf.select("key", "block", "tf", idf.alias("idf"), F.when(F.lead("block").over(along) == F.col("block") + 1, F.lead("tf").over(along)).alias("next"))
    x = F.col("tf") * F.col("idf")
    sums = tf.select("key", "block", (x * x).alias("n"), (x * F.col("next") * F.col("idf")).alias("d"))
    every = rows.select("key", F.explode(F.expr(f"sequence(0, cast(ceil(size(s) / {BLOCK}) as int) - 1)")).alias("block"), F.lit(0.0).alias("n"), F.lit(0.0).alias("d"))
    sums = sums.unionByName(every).groupBy("key", "block").agg(F.sum("n").alias("n"), F.coalesce(F.sum("d"), F.lit(0.0)).alias("d"))
    following = F.lead("n").over(Window.partitionBy("key").orderBy("block"))
    cosine = F.when((F.col("n") > 0) & (following > 0), F.col("d") / (F.sqrt("n") * F.sqrt(following))).otherwise(0.0)
    near = sums.select("key", "block", following.isNotNull().alias("ok"), F.round(1 - F.round(cosine, 6), 6).alias("strength")).where("ok")
    return near.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "strength"))), lambda b: b["strength"]).alias("strengths"))


def _greedy(least: int, most: int, target: int) -> Column:
    """Last sentences (from 0) of segments cut one after the other, of columns p (running word counts) and b
    (boundaries i, strength, hard, words up to there).

    From a start, cuts may be made at boundaries with least to most words, else at a heading with EARLY words
    or more, else at the sentence with the number of words nearest to target. Of several boundaries those
    within 0.05 of the strongest count as equally strong; then the nearest to target, then the strongest,
    then the first wins. What is left with fewer than `least` words is the last segment. A first sentence
    of more than `most` words lifts the upper limit.
    """
    p, b = F.col("p"), F.col("b")
    n, total = F.size(p), F.element_at(p, -1)

    def best(cs, base):
        def ranked(strongest):
            def rank(c):
                behind = strongest - c["strength"]
                return F.struct(F.when(behind <= 0.05, 0.0).otherwise(behind).alias("a"), F.abs(c["words"] - base - target).alias("d"), (-c["strength"]).alias("s"), c["i"].alias("i"))

            return F.array_min(F.transform(cs, rank))["i"]

        return bound(F.array_max(F.transform(cs, lambda c: c["strength"])), ranked)

    def end(at, base):
        limit = F.when(p[at] - base > most, total).otherwise(base + most)
        inside = F.filter(b, lambda c: (c["i"] >= at) & (c["words"] <= limit))

        def chosen(cs):
            late = F.filter(cs, lambda c: c["words"] - base >= least)
            early = F.filter(cs, lambda c: c["hard"] & (c["words"] - base >= min(EARLY, least)) & (c["words"] - base < least))
            nearest = F.array_min(F.transform(F.sequence(at, n - 1), lambda i: F.struct(F.abs(p[i] - base - target).alias("d"), i.alias("i"))))["i"]
            return F.when(F.size(late) > 0, best(late, base)).when(F.size(early) > 0, best(early, base)).otherwise(nearest)

        return F.when(total - base < least, n - 1).otherwise(bound(inside, chosen))

    def step(acc, i):
        base = F.when(acc["at"] > 0, p[F.greatest(acc["at"] - 1, F.lit(0))]).otherwise(F.lit(0).cast("bigint"))
        cut = bound(end(acc["at"], base), lambda e: F.struct((e + 1).alias("at"), F.array_append(acc["ends"], e).alias("ends")))
        return F.when(i < acc["at"], acc).otherwise(cut)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))
    return F.aggregate(F.sequence(F.lit(0), n - 1), start, step)["ends"]


def _refined(least: int) -> Column:
    """Spans (first, last, split) of columns s, p and spans (first, last): those with two major headings or more are cut at them."""
    s, p = F.col("s"), F.col("p")

    def words(a, z):
        return p[z] - F.when(a > 0, p[F.greatest(a - 1, F.lit(0))]).otherwise(F.lit(0).cast("bigint"))

    def starts(span, heads):
        three = F.size(heads) >= 3

        def step(acc, h):
            last = F.element_at(acc, -1)
            fits = (h - last > 1) & (three | (words(last, h - 1) >= SIDE) & (words(h, span["last"]) >= SIDE))
            return F.when(fits, F.array_append(acc, h)).otherwise(acc)

        return F.aggregate(F.slice(heads, 2, F.size(heads)), F.array(span["first"]), step)

    def cut(span):
        heads = F.filter(F.sequence(span["first"], span["last"]), lambda i: is_major(s[i]))

        def of(hs):
            split = (F.size(hs) >= 3) | (F.size(hs) == 2) & (words(span["first"], span["last"]) >= least)
            at = F.when(split, starts(span, hs)).otherwise(F.array(span["first"]))
            return bound(at, lambda a: F.transform(a, lambda x, i: F.struct(x.alias("first"), F.coalesce(F.get(a, i + 1) - 1, span["last"]).alias("last"), (F.size(a) > 1).alias("split"))))

        return bound(heads, of)

    return F.flatten(F.transform(F.col("spans"), cut))


def _merged(least: int, most: int) -> Column:
    """Spans of columns s, p and spans, the last joined to the one before if it is short, unless it begins with a major heading."""
    s, p, spans = F.col("s"), F.col("p"), F.col("spans")
    n = F.size(spans)
    last, before = spans[n - 1], spans[n - 2]
    own = p[last["last"]] - p[last["first"] - 1]
    both = p[last["last"]] - F.when(before["first"] > 0, p[F.greatest(before["first"] - 1, F.lit(0))]).otherwise(F.lit(0).cast("bigint"))
    joined = F.array_append(F.slice(spans, 1, n - 2), F.struct(before["first"].alias("first"), last["last"].alias("last"), F.lit(False).alias("split")))
    return F.when(n < 2, spans).when((own < least) & ~is_major(s[last["first"]]) & (both <= 1.25 * most), joined).otherwise(spans)


def segment_cuts(docs: DataFrame, least: int = LEAST, most: int = MOST, target: int = TARGET) -> DataFrame:
    """docs' doc_id with `segments`, and the content sentences `s` they are spans of: array of (first, last, split).

    Sentences without references, and without long ones that repeat, are cut one segment after the other
    (`_greedy`) at boundaries between blocks of sentences (`block_strengths`) and before headings; a
    segment with several major headings is cut at them; a short last one joins the one before. A text of
    at most `most` words is one segment before its headings are looked at.

    A row for each row of docs, repeated ones too; texts that are null or without content have no segments.
    A row's sentences stay in the row; only texts that must be cut have their terms counted across rows.
    Sentences are read four times, so they are written once.
    """
    rows = computed(spread(docs.select("doc_id", "text")), s=content_sentences(marked_sentences(F.col("text")))).drop("text")
    rows = written(computed(rows, p=running_sums(F.transform("s", lambda x: x["words"]))))
    long = (F.size("p") > 0) & (F.coalesce(F.get("p", F.size("p") - 1), F.lit(0)) > most)
    whole = F.when(F.size("s") > 0, F.array(F.struct(F.lit(0).alias("first"), (F.size("s") - 1).alias("last")))).otherwise(F.array().cast("array<struct<first:int,last:int>>"))
    short = rows.where(~long).withColumn("spans", whole).withColumn("spans", _refined(least)).select("doc_id", "s", "p", F.col("spans").alias("segments"))
    cut = rows.where(long).withColumn("key", F.xxhash64("s"))
    cut = cut.join(block_strengths(cut.select("key", "s")), "key", "left")  # a text of one block has no strengths

    def boundary(i):
        following = F.col("s")[i + 1]
        heading = following["heading"] & ~following["text"].rlike(f"^(?:{REFERENCE_TITLE})$")
        strength = F.when(heading, F.when(following["level"].isin(1, 2), MAJOR).otherwise(MINOR)).when((i + 1) % BLOCK == 0, F.get("strengths", ((i + 1) / BLOCK).cast("int") - 1))
        return F.struct(i.alias("i"), strength.alias("strength"), heading.alias("hard"), F.col("p")[i].alias("words"))

    places = F.when(F.size("s") > 1, F.sequence(F.lit(0), F.size("s") - 2)).otherwise(F.array().cast("array<int>"))
    cut = computed(cut, b=F.filter(F.transform(places, boundary), lambda x: x["strength"].isNotNull()))
    cut = computed(cut, ends=_greedy(least, most, target))
    cut = cut.withColumn("spans", F.transform("ends", lambda e, i: F.struct(F.coalesce(F.when(i > 0, F.get("ends", i - 1)) + 1, F.lit(0)).alias("first"), e.alias("last"))))
    cut = cut.withColumn("spans", _refined(least)).withColumn("segments", _merged(least, most))
    return short.unionByName(cut.select("doc_id", "s", "p", "segments")).select("doc_id", "s", "segments")


def segments(docs: DataFrame, parts: bool = False) -> DataFrame:
    """doc_id, segment_id (from 1), first_sentence, last_sentence (their numbers in the text), word_count, split_reason, content: a row for each segment of `segment_cuts`.

    With `parts`, also the marked sentences themselves."""
    d = segment_cuts(docs).select("doc_id", "s", F.posexplode("segments").alias("k", "x"))
    part = F.slice("s", F.col("x.first") + 1, F.col("x.last") - F.col("x.first") + 1)
    d = d.select("doc_id", (F.col("k") + 1).alias("segment_id"), part.alias("part"), "x.split")
    return d.select(
        "doc_id", "segment_id", *(["part"] if parts else []), F.col("part")[0]["id"].alias("first_sentence"), F.element_at("part", -1)["id"].alias("last_sentence"),
        F.aggregate("part", F.lit(0), lambda a, s: a + s["words"]).alias("word_count"),
        F.when(F.col("split"), "major_heading_boundary").otherwise("semantic_or_size_boundary").alias("split_reason"), F.array_join(F.transform("part", lambda s: s["text"]), " ").alias("content"),
    )
