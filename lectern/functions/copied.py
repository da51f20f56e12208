"""Text copied from pages: lines of furniture and side boxes go, broken lines join. Native expressions over one column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.paragraphs import bound

# fixed values: titles of sections, in lower case
SECTIONS = ("introduction", "dyslexia", "conclusion", "screening and assessment", "discussion", "method", "methods", "results", "interventions")
TITLES = r"^[A-Z][A-Z0-9 '&/:-]{2,}$|^\d+(?:\.\d+)*\.?\s+[A-Z][A-Za-z ,:&/-]{2,}$"
# fixed values: a box of key points begins with this line and swallows so many lines of at most so many words
BOX, REACH, WORDS = "key points", 8, 28
# fixed values: leftovers, page lines, contacts, links, notices and affiliations of page furniture
FRAGMENTS = ("london and b", "properly cited.", "published by", "author manuscript")
PAGE = r"^review$|\bcurrent opinion\b|^volume\s+\d+|^issue\s+\d+|^number\s+\d+|^pages?\s+\d+|^-?\s*\d+\s*-?$|^\d+\s*/\s*\d+$"
CONTACT = r"^(?:e-?mail|contact|correspondence)\s*:|^correspondence\s+(?:to|author)\b|^(?:tel\.?|telephone|fax)\s*:"
ADDRESS, PHONE, PHONE_WORDS = r"\b[a-z0-9_.%+-]+@[a-z0-9_.-]+\.[a-z]{2,}\b", r"\+?\d[\d\s().-]{6,}\d", "tel|fax"
LINK, LABELLED = r"^(?:https?://|www\.)\S+$|^(?:doi\s*:|https?://doi\.org/)\S+", r"^(?:available\s+at|source|url|link)\s*:?\s+(?:https?://|www\.)"
NOTICE = "^(?:copyright|published by|author manuscript)|©|all rights reserved"
PLACES = "university|college|department|division|school|institute|hospital|centre|center"
LOCATIONS = "london|oxford|cambridge|uk|usa|australia|canada|europe"
TAIL, TERMS = r"\b(?:and|of|by|inc|ltd)$", "license|attribution|properly cited"

ENDED, NUMBER_BEFORE, NUMBER, CLOSES, OPENS, GOES_ON = "[.!?:]$", r"(?:^|[^\p{L}\p{N}_])[A-Za-z]+$", r"^\d+(?:\.\d+)?(?:[^\p{L}\p{N}_]|$)", r"^[^\[]*\]", r"\[[^\]]*$", r"^[\p{Ll}(]"


def scan(values: Column, zero: Column, step: Callable[[Column, Column], Column], kind: str, chunk: int = 256) -> Column:
    """Array of the states (structs of `kind`) after each value, beginning with zero.

    A chunk of values is folded into an array at a time, so that long arrays aren't copied for each value.
    """
    none = F.array().cast(f"array<{kind}>")

    def within(state, part):
        def add(a, x):
            return bound(step(a["s"], x), lambda n: F.struct(n.alias("s"), F.array_append(a["o"], n).alias("o")))

        return F.aggregate(part, F.struct(state.alias("s"), none.alias("o")), add)

    def whole(v):
        steps = F.when(F.size(v) > 0, F.sequence(F.lit(0), F.floor((F.size(v) - 1) / chunk).cast("int"))).otherwise(F.array().cast("array<int>"))

        def add(a, k):
            return bound(within(a["s"], F.slice(v, k * chunk + 1, chunk)), lambda x: F.struct(x["s"].alias("s"), F.array_append(a["o"], x["o"]).alias("o")))

        return F.flatten(F.aggregate(steps, F.struct(zero.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("o")), add)["o"])

    return bound(values, whole)


def is_section_title(line: Column) -> Column:
    return ~line.rlike(ENDED) & (line.rlike(TITLES) | F.lower(line).isin(*SECTIONS))


def is_furniture(line: Column) -> Column:
    """Page numbers, contacts, links, notices, affiliations and leftovers on a line by themselves."""
    def of(t, n):
        commas = F.length(t) - F.length(F.replace(t, F.lit(","), F.lit("")))
        location = t.rlike(LOCATIONS)
        return (
            t.isin(*FRAGMENTS) | t.rlike(PAGE) | t.rlike(CONTACT) | (n <= 22) & t.rlike(ADDRESS) | (n <= 12) & t.rlike(PHONE) & t.rlike(PHONE_WORDS)
            | t.rlike(LINK) | (n <= 12) & t.rlike(LABELLED) | (n <= 18) & t.rlike(NOTICE) | (n <= 8) & F.contains(t, F.lit("open access"))
            | (n <= 22) & location & (t.rlike(PLACES) | (commas >= 2)) | (n <= 5) & t.rlike(TAIL) | (n <= 8) & t.rlike(TERMS)
        )

    return bound(F.lower(line), lambda t: bound(F.regexp_count(t, F.lit(r"\S+")), lambda n: of(t, n)))


def _facts(line: Column) -> Column:
    n = F.regexp_count(line, F.lit(r"\S+"))
    point = line.rlike("^[-*]") | (n <= WORDS) & (line.endswith(";") | ~line.rlike(ENDED))
    return F.struct((line == "").alias("blank"), is_section_title(line).alias("title"), point.alias("point"), (F.lower(line) == BOX).alias("box"), is_furniture(line).alias("page"))


def _without_boxes(lines: Column) -> Column:
    """Lines without furniture, and without boxes of key points: a line that begins one swallows up to REACH
    lines like points, until a section title or a line of another kind."""
    def step(s, x):
        left = F.when(x["title"] | ~x["point"], 0).otherwise(s["left"])
        swallowed = (s["left"] > 0) & (left > 0)
        return (
            F.when(x["blank"], F.struct(s["left"].alias("left"), F.lit(True).alias("kept")))
            .when(swallowed, F.struct((s["left"] - 1).alias("left"), F.lit(False).alias("kept")))
            .when(x["box"], F.struct(F.lit(REACH).alias("left"), F.lit(False).alias("kept")))
            .otherwise(F.struct(F.lit(0).alias("left"), (~x["page"]).alias("kept")))
        )

    def kept(ls):
        states = scan(F.transform(ls, _facts), F.struct(F.lit(0).alias("left"), F.lit(True).alias("kept")), step, "struct<left:int,kept:boolean>")
        return F.transform(F.filter(F.zip_with(ls, states, lambda l, s: F.struct(l.alias("l"), s["kept"].alias("k"))), lambda x: x["k"]), lambda x: x["l"])

    return bound(lines, kept)


def _joined(lines: Column) -> Column:
    """Text of the lines, those that a page broke joined: after a hyphen, inside a citation, before a number, or where lower case or a bracket goes on."""
    def facts(ls):
        def of(line, i):
            last = F.coalesce(F.when(i > 0, F.get(ls, i - 1)), F.lit(""))
            free = (last != "") & (line != "") & ~is_section_title(line)
            plain = F.when(last.endswith("-"), "h").when(line.rlike(NUMBER) & last.rlike(NUMBER_BEFORE), "s").when(last.rlike(ENDED), "n").when(line.rlike(GOES_ON), "s").otherwise("n")
            return F.struct(F.when(free, plain).otherwise("n").alias("plain"), (free & ~last.endswith("-") & line.rlike(CLOSES)).alias("closes"), F.contains(line, F.lit("]")).alias("closed"), line.rlike(OPENS).alias("opens"))

        return F.transform(ls, of)

    def step(s, x):
        return bound(F.when(s["open"] & x["closes"], "c").otherwise(x["plain"]), lambda how: F.struct(how.alias("how"), (x["opens"] | (how != "n") & s["open"] & ~x["closed"]).alias("open")))

    def text(ls):
        states = scan(facts(ls), F.struct(F.lit("n").alias("how"), F.lit(False).alias("open")), step, "struct<how:string,open:boolean>")

        def of(how):
            def piece(line, i):
                before = F.when(i == 0, "").otherwise(F.element_at(F.create_map(*[F.lit(x) for x in ("n", "\n", "h", "", "c", "", "s", " ")]), F.get(how, i)["how"]))
                own = F.when(F.coalesce(F.get(how, i + 1)["how"] == "h", F.lit(False)), F.left(line, F.length(line) - 1)).otherwise(line)
                return F.concat(before, own)

            return F.array_join(F.transform(ls, piece), "")

        return bound(states, of)

    return bound(lines, text)


def clean_copied(text: Column) -> Column:
    """Text copied from a page as running text; empty for null.

    Plain quotes, blanks and line ends; no furniture and no boxes of key points (`_without_boxes`); broken lines
    joined (`_joined`); words that copying ran together apart; at most one empty line in a row.
    """
    lines = F.transform(F.split(X.basic_formatting(F.coalesce(text, F.lit(""))), "\n"), lambda x: F.trim(x))
    t = X.mend_merged_words(_joined(_without_boxes(lines)))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "[ \t]{2,}|\t", " "), "\n{3,}", "\n\n"), r"^\s+|\s+$", "")
