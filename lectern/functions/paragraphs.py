"""Paragraphs, headings and sentences of a text with its reading marks: native expressions over one column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: titles of sections that list references
REFERENCE_TITLES = ("references", "bibliography", "works cited")
# fixed values: endings after which no sentence ends
NO_END = ("e.g.", "i.e.", "dr.", "mr.", "mrs.", "ms.", "prof.", "fig.", "etc.", "vs.", "al.")
# fixed values: characters of copied text and what stands for them (the rest of the first goes)
COPIED, PLAIN = "\r ‘’“”–—−​‌‍﻿", "\n ''\"\"---"

#: A word of letters, digits, apostrophes and hyphens that begins and ends with a letter or digit.
WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_'-]*[\p{L}\p{N}_])?"
MARKDOWN_TITLE = r"#{1,6} [^\s].*"
REFERENCE_TITLE = r"(?:#{1,6} )?(?:\d+(?:\.\d+)*\.? )?[ :-]*(?i:" + "|".join(REFERENCE_TITLES) + r")[ :-]*"
REFERENCE_LINE = r"(?i)(^\[\d+\])|https?://|www[.]"
_SPLIT = r"(?<=[.!?])(?<!(?i:" + "|".join(x.replace(".", "[.]") for x in NO_END) + r"))\s+(?=[A-Z0-9\"'(\[])"


def bound(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def paragraphs(text: Column) -> Column:
    """Paragraphs of a text: lines joined by blanks, between empty lines; a heading line is a paragraph of its own."""
    t = F.translate(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), COPIED, PLAIN)
    t = F.regexp_replace(F.regexp_replace(t, "[ \t]{2,}|\t", " "), " \n ?|\n ", "\n")  # what stays as it is need not match
    t = F.regexp_replace(t, f"(?md)^((?:{MARKDOWN_TITLE})|(?:{REFERENCE_TITLE}))$", "\n$1\n")
    return F.filter(F.transform(F.split(t, "\n\n+"), lambda p: F.trim(F.translate(p, "\n", " "))), lambda p: p != "")


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)))


def marked_sentences(text: Column) -> Column:
    """Array of (text, words, level, heading, reference): sentences in order; headings are sentences too.

    level is that of a markdown heading or 0. All from the first heading of a reference section on is
    reference, and so are sentences with a link or that begin with a numbered citation.
    """
    def title(p):
        return p.rlike(f"^(?:{REFERENCE_TITLE})$")

    def of(p, i, first):
        level = F.length(F.regexp_extract(p, r"^(#{1,6}) [^\s]", 1))

        def marked(m):
            parts = F.when(m["heading"], F.array(p)).otherwise(F.filter(F.transform(F.split(p, _SPLIT), lambda x: F.trim(x)), lambda s: s != ""))
            return F.transform(parts, lambda s: F.struct(
                s.alias("text"), word_count(s).alias("words"), m["level"].alias("level"), m["heading"].alias("heading"),
                (m["inside"] | ~m["heading"] & s.rlike(REFERENCE_LINE)).alias("reference"),
            ))

        return bound(F.struct(level.alias("level"), ((level > 0) | title(p)).alias("heading"), ((first > 0) & (i + 1 >= first)).alias("inside")), marked)

    def whole(ps):
        first = F.array_position(F.transform(ps, title), F.lit(True))
        return bound(first, lambda at: F.flatten(F.transform(ps, lambda p, i: of(p, i, at))))

    return bound(paragraphs(text), whole)


def content_sentences(sentences: Column, long: int = 10) -> Column:
    """Those that are no references, and of equal ones of `long` words or more the first; with their number from 1 as `id`."""
    def keys(ss):
        return F.array_sort(F.transform(F.filter(ss, lambda s: s["words"] >= long), lambda s: F.struct(F.xxhash64(F.lower(F.regexp_replace(s["text"], r"\s+", " "))).alias("k"), s["id"].alias("id"))))

    def again(key):
        return F.transform(F.filter(key, lambda x, i: (i > 0) & (F.get(key, i - 1)["k"] == x["k"])), lambda x: x["id"])

    def kept(ss):
        return bound(bound(keys(ss), again), lambda gone: F.filter(ss, lambda s: ~F.array_contains(gone, s["id"])))

    return bound(F.filter(F.transform(sentences, lambda s, i: s.withField("id", i + 1)), lambda s: ~s["reference"]), kept)


def running_sums(values: Column, step: int = 256) -> Column:
    """Array of sums up to each element, made `step` at a time so that long arrays aren't copied for each element."""
    def some(total, v, k):
        def add(a, x):
            return F.struct((a["s"] + x).alias("s"), F.array_append(a["o"], a["s"] + x).alias("o"))

        part = F.slice(v, k * step + 1, step)
        return F.aggregate(part, F.struct(total.alias("s"), F.array().cast("array<bigint>").alias("o")), add)

    def whole(v):
        none = F.struct(F.lit(0).cast("bigint").alias("s"), F.array().cast("array<array<bigint>>").alias("o"))
        steps = F.when(F.size(v) > 0, F.sequence(F.lit(0), F.floor((F.size(v) - 1) / step).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.aggregate(steps, none, lambda a, k: bound(some(a["s"], v, k), lambda x: F.struct(x["s"].alias("s"), F.array_append(a["o"], x["o"]).alias("o"))))["o"])

    return bound(F.transform(values, lambda x: x.cast("bigint")), whole)
