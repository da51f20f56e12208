"""Sentence splitting, by marks or with abbreviations, domains and numbers kept whole: patterns over whole texts.

Periods that end nothing are turned into a placeholder by a chain of patterns, the text is cut at the
marks that are left, and the placeholders become periods again. The patterns mean the same in Java and
in Python, so a column stays in the JVM and a single text can be cut in Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import collapse_spaces

# fixed values: words before a period that may end no sentence
ABBREVIATIONS = ("a.m", "c", "e.g", "i.e", "etc", "mr", "mrs", "ms", "dr", "prof", "fig", "vs", "u.s", "u.k", "no", "p.m", "st")
# fixed values: what follows the period of a domain
WEB_SUFFIXES = ("com", "edu", "gov", "mil", "net", "org")

_KEPT = "․"
_BEFORE_CAPITAL, _BEFORE_WORD = ("etc", "c"), ("u.s", "u.k")
_PLAIN = [a for a in ABBREVIATIONS if a not in _BEFORE_CAPITAL + _BEFORE_WORD]


def _either(words) -> str:
    return "(?i:" + "|".join(w.replace(".", "[.]") for w in words) + ")"


#: Patterns of which the first group stays and the period after it is kept: plain abbreviations; some before
#: anything but a capital; countries before anything but a capitalised word that is no acronym; numbers;
#: names with inner periods; bare domain suffixes.
GUARDS = [
    rf"(?<![A-Za-z.])({_either(_PLAIN)})[.]",
    rf"(?<![A-Za-z.])({_either(_BEFORE_CAPITAL)})[.](?! [A-Z])",
    rf"(?<![A-Za-z.])({_either(_BEFORE_WORD)})[.](?! (?![A-Z]{{1,6}}(?![A-Za-z-]))[A-Z])",
    r"([0-9])[.](?=[0-9])",
    r"([A-Za-z0-9])[.](?=[A-Za-z])",
    rf"()[.](?={_either(WEB_SUFFIXES)}(?![A-Za-z]))",
]
_UNIT = "[^.!?]*[.!?]|[^.!?]+$"
_GUARDS, _UNITS = [re.compile(g) for g in GUARDS], re.compile(_UNIT)


def split_at_marks(text: Column) -> Column:
    """Parts after a mark and blanks that begin with a capital, a digit, a quote or a bracket; four
    abbreviations don't end one. Native, so it works on any number of texts at scan speed."""
    t = collapse_spaces(text)
    for a in ("e.g.", "i.e.", "U.S.", "U.K."):
        t = F.replace(t, F.lit(a), F.lit(a.replace(".", _KEPT)))
    parts = F.split(t, r"(?<=[.!?])\s+(?=[A-Z0-9\"'(\[])")
    return F.filter(F.transform(parts, lambda p: F.trim(F.translate(p, _KEPT, "."))), lambda p: p != "")


def split_simply(text: Column) -> Column:
    """Parts after Western or Chinese end marks and at line ends, without empty ones."""
    marked = F.regexp_replace(text, "([.!?](?=\\s|$)|[。！？])", "$1\n")
    return F.filter(F.transform(F.split(marked, "\n"), collapse_spaces), lambda p: p != "")


def sentence_units(text: Column | str) -> Column:
    """Sentence-like units of a column; decimals, domains and abbreviations keep their periods. None for null."""
    t = collapse_spaces(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    for g in GUARDS:
        t = F.regexp_replace(t, g, "$1" + _KEPT)
    units = F.regexp_extract_all(t, F.lit(f"({_UNIT})"), F.lit(1))
    return F.filter(F.transform(units, lambda u: F.trim(F.translate(u, _KEPT, "."))), lambda u: u != "")


def scan_sentences(text: str | None) -> list[str]:
    """`sentence_units` of one text."""
    t = " ".join((text or "").split())
    for g in _GUARDS:
        t = g.sub(r"\g<1>" + _KEPT, t)
    return [u for u in (x.replace(_KEPT, ".").strip() for x in _UNITS.findall(t)) if u]
