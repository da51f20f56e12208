"""Column functions over text: counting, normalising, predicates. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the five word definitions; counts differ, so each has a name
WORD = {
    "ascii": r"[A-Za-z0-9]+(?:['-][A-Za-z0-9]+)*",
    "ascii_one_suffix": r"[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)?",
    "unicode": r"[\p{L}\p{N}_](?:[\p{L}\p{N}_'-]*[\p{L}\p{N}_])?",
    "nonblank": r"\S+",
    "letters": r"[A-Za-z][A-Za-z'-]*",
}
# fixed values: characters and words that predicates look for
MATH_SYMBOLS = r"[=<>^∫√πΣΔ±÷×/\\]"
SECOND_PERSON = r"(?i)(?:^|[^A-Za-z0-9_'])(?:you're|you've|you'll|yourself|your|you)(?=$|[^A-Za-z0-9_])"
# \W is [^A-Za-z0-9_], which Java tests ten times more slowly
OPTION_MARKER = r"(?:^|\W)[A-Da-d]\.\s"
MOJIBAKE = ["�", "鈥", "茅", "Ã", "Â", "â€", "鍏", "嶅", "姟", "漒", "淐"]
CJK = r"[\x{4e00}-\x{9fff}]"
ENGLISH_STOP = ["the", "and", "to", "of", "in", "is", "that", "for", "on", "with", "as", "are", "be", "by", "this", "from", "or", "an", "at", "not", "can", "will", "you", "your"]
MARKDOWN = r"(^|\n)\s*(#{1,6}\s+|[-*]\s+|\d+\.\s+)"
REFUSALS = ["i cannot", "i can't", "as an ai", "i am unable", "cannot summarize"]
REFERENCE_HEADINGS = ["references", "bibliography", "works cited"]
QUOTES = {" ": " ", "​": "", "‌": "", "‍": "", "﻿": "", "‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "−": "-"}
# fixed values: words that copying has run together
MERGED_WORDS = {"accuracymore": "accuracy more", "themean": "the mean", "ismore": "is more"}


def word_count(text: Column, kind: str = "ascii") -> Column:
    """Number of words by one of the definitions in WORD."""
    return F.regexp_count(text, F.lit(WORD[kind]))


def tokens(text: Column) -> Column:
    """Lower-case alphabetic tokens, with inner hyphens and apostrophes."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z][a-z'-]*)"), F.lit(1))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def char_count(text: Column, kind: str) -> Column:
    """Number of characters of a class: what is lost without them, since a list of matches costs more."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{kind}+", ""))


def alpha_ratio(text: Column) -> Column:
    """Letters among all characters."""
    return ratio(char_count(text, r"\p{L}"), F.length(text))


def dense_alpha_ratio(text: Column) -> Column:
    """Letters among characters that aren't blank."""
    return ratio(char_count(text, r"\p{L}"), char_count(text, r"\S"))


def latin_ratio(text: Column) -> Column:
    """A-Z and a-z among letters."""
    return ratio(char_count(text, "[A-Za-z]"), char_count(text, r"\p{L}"))


def collapse_spaces(text: Column) -> Column:
    """Runs of blanks become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def basic_formatting(text: Column) -> Column:
    """Line ends, unusual spaces, quotes and dashes in plain form; at most one empty line in a row."""
    t = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    keep = {k: v for k, v in QUOTES.items() if v}
    t = F.translate(t, "".join(keep) + "".join(k for k, v in QUOTES.items() if not v), "".join(keep.values()))
    t = F.regexp_replace(F.regexp_replace(t, "[ \t]{2,}|\t", " "), "\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def mojibake_hits(text: Column) -> Column:
    """Which damaged sequences occur, in order of code points."""
    found = F.filter(F.array(*[F.lit(m) for m in MOJIBAKE]), lambda m: F.contains(text, m))
    return F.array_sort(found)


def strip_cjk(text: Column) -> Column:
    return F.regexp_replace(text, CJK, "")


def english_score(text: Column, most: int = 220) -> Column:
    """Share of stop words in the first tokens."""
    first = F.slice(F.regexp_extract_all(F.lower(text), F.lit("([a-z']+)"), F.lit(1)), 1, most)
    return ratio(F.size(F.filter(first, lambda t: t.isin(*ENGLISH_STOP))), F.size(first))


def is_clean_english(text: Column) -> Column:
    """No CJK or replacement characters, and nearly all letters Latin."""
    return (text != "") & (F.regexp_count(text, F.lit(CJK)) == 0) & (~F.contains(text, F.lit("�"))) & (latin_ratio(text) >= 0.97)


def strip_citations(text: Column) -> Column:
    """Without bracketed numbers and references to figures, blanks put right."""
    t = F.regexp_replace(text, r"\[[0-9,\-; ]+\]", " ")
    t = F.regexp_replace(t, r"(?i)\((?:Fig|Table|Eq|Ref)s?\.?[^\)]*\)", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"\s+([,.;:!?])", "$1"))


def normalize_heading(text: Column) -> Column:
    """Heading text without marks and numbering, in lower case."""
    t = F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"^#{1,6}\s+", "")
    t = F.regexp_replace(t, r"^\d+(\.\d+)*\.?\s+", "")
    return F.lower(F.regexp_replace(F.regexp_replace(t, r"^[ :-]+|[ :-]+$", ""), r"\s+", " "))


def terminal_marks(text: Column) -> Column:
    """Sentence count as marks followed by a blank or the end."""
    return F.regexp_count(F.trim(text), F.lit(r"[.!?](?:\s|$)"))


def split_count(text: Column) -> Column:
    """Sentence count as parts between marks of any script that aren't blank."""
    return F.size(F.filter(F.split(text, "[.!?。！？]+"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")) != ""))


def protected_count(text: Column) -> Column:
    """Sentence count with four abbreviations protected; a tail without a mark counts."""
    t = collapse_spaces(text)
    for a, b in (("e.g.", "eg<DOT>"), ("E.G.", "eg<DOT>"), ("i.e.", "ie<DOT>"), ("I.E.", "ie<DOT>"), ("U.S.", "US<DOT>"), ("U.K.", "UK<DOT>")):
        t = F.replace(t, F.lit(a), F.lit(b))
    n = F.regexp_count(t, F.lit(r"[.!?]+(?:\s|$|[\"')\]])"))
    tail = F.trim(F.regexp_replace(t, r"^(?s:.*)[.!?](?=\s|$|[\"')\]])", ""))
    return F.when(t == "", 0).when(n == 0, 1).otherwise(n + (tail != "").cast("int"))


def force_period(text: Column) -> Column:
    """One sentence mark at the end, a period: trailing periods collapse, one final mark is replaced."""
    t = F.regexp_replace(collapse_spaces(text), r"(?:\.\s*)+\.$", ".")
    t = F.rtrim(F.regexp_replace(t, r"[.!?]$", ""))
    return F.when(collapse_spaces(text) == "", "").otherwise(F.concat(t, F.lit(".")))


def mend_merged_words(text: Column) -> Column:
    """Known words that copying has run together, apart again."""
    def alone(first, rest):  # what is before is looked at where the first letter fits only
        return rf"{first}(?<![\p{{L}}\p{{N}}_]{first}){rest}(?![\p{{L}}\p{{N}}_])"

    for bad, good in MERGED_WORDS.items():
        text = F.regexp_replace(text, "(?i)" + alone(bad[0], bad[1:]), good)
    text = F.regexp_replace(text, alone("t", "he(mean|same|following|first|second)"), "the $1")
    return F.regexp_replace(text, alone("i", "s(more|less|likely|not)"), "is $1")


def has_markdown(text: Column) -> Column:
    return F.contains(text, F.lit("```")) | text.rlike(MARKDOWN)


def has_refusal(text: Column) -> Column:
    return F.lower(text).rlike("|".join(REFUSALS))


def preview(text: Column, limit: int = 160) -> Column:
    """Collapsed text, cut with three dots beyond the limit."""
    t = collapse_spaces(text)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.left(t, F.lit(max(0, limit - 3))), F.lit("...")))


def lookup_term(text: Column, most: int = 80) -> Column:
    """A term for the dictionary: collapsed, cut, without edge punctuation, lower case."""
    return F.lower(F.regexp_replace(F.left(collapse_spaces(text), F.lit(most)), "^[^a-zA-Z]+|[^a-zA-Z]+$", ""))


def is_single_word(text: Column, most: int = 50) -> Column:
    """One English word with inner apostrophes or hyphens."""
    return (F.length(text) <= most) & text.rlike("^[A-Za-z]+(?:['-][A-Za-z]+)*$")


def redact(text: Column) -> Column:
    """Bearer tokens replaced."""
    return F.regexp_replace(text, r"Bearer\s+[A-Za-z0-9_.=-]+", "Bearer <TOKEN>")


def excerpt_bucket(words: Column) -> Column:
    """short 250-499, medium 500-800, long 801-1200, else null."""
    return F.when(words.between(250, 499), "short").when(words.between(500, 800), "medium").when(words.between(801, 1200), "long")


def natural_bucket(words: Column) -> Column:
    """short to 400 words, medium to 800, long beyond."""
    return F.when(words <= 400, "short").when(words <= 800, "medium").otherwise("long")


def is_reference_line(text: Column) -> Column:
    """A line that cites: a link, or a number in brackets first."""
    t = F.trim(F.lower(text))
    return t.rlike(r"^\[\d+\]") | t.rlike(r"https?://|www\.")


def is_upper_heading(paragraph: Column) -> Column:
    """At most 12 words: a numeral alone, or capitals, digits and marks only; empty counts."""
    p = F.trim(paragraph)
    words = F.regexp_count(p, F.lit(r"\S+"))
    return (p == "") | ((words <= 12) & (p.rlike(r"^(?:[IVXLCM]+\.?|[0-9]+\.?)$") | p.rlike(r"^(?:[IVXLCM]+\.?\s+)?[A-Z0-9][A-Z0-9 \-:/,&()]+$")))


def is_noise_paragraph(paragraph: Column) -> Column:
    """Short, a link, addresses, few letters or many digits."""
    p = F.trim(paragraph)
    digits = F.regexp_count(p, F.lit("[0-9]"))
    return (F.length(p) < 40) | F.lower(p).rlike("^https?://") | (F.regexp_count(p, F.lit("@")) >= 2) | (dense_alpha_ratio(p) < 0.65) | (digits > F.greatest(F.lit(20.0), F.length(p) * 0.2))


def citation_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\[[^\]]+\]|\(\s*\d{4}\s*\)"))


def is_summary_candidate(sentence: Column) -> Column:
    """Eight words or more, no link, few citations, not only numbers."""
    return (word_count(sentence, "unicode") >= 8) & ~F.lower(sentence).rlike(r"https?://|www\.") & ~sentence.rlike(r"^[\[\]\d\s,().;:-]+$") & (citation_count(sentence) < 4) & ~sentence.rlike(r"^\[?\d+\]?:")


def task_type(text: Column) -> Column:
    """Kind of assignment by the first phrase that occurs, in a fixed order."""
    t = F.lower(text)
    rules = [("literature_review", ["literature review"]), ("research_paper", ["research paper", "thesis", "dissertation"]), ("essay", ["essay"]), ("report", ["report"]), ("abstract", ["abstract"]), ("presentation", ["presentation"]), ("proposal", ["proposal"]), ("annotated_bibliography", ["annotated bibliography"])]
    out = None
    for name, words in rules:
        hit = t.rlike("|".join(words))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other_assignment_like")


def format_duration(seconds: Column) -> Column:
    """1h 02m 03s, 2m 03s or 3s; unknown for negative or not-a-number."""
    total = F.bround(seconds).cast("long")
    h, m, s = F.floor(total / 3600), F.floor(total / 60) % 60, total % 60
    text = F.when(h > 0, F.format_string("%dh %02dm %02ds", h, m, s)).when(m > 0, F.format_string("%dm %02ds", m, s)).otherwise(F.format_string("%ds", s))
    return F.when((seconds < 0) | F.isnan(seconds) | (seconds == float("inf")) | seconds.isNull(), "unknown").otherwise(text)


def relative_date(now: Column, then: Column) -> Column:
    """How long ago in minutes, hours or days; a date beyond a week."""
    mins = F.floor((F.unix_seconds(now) - F.unix_seconds(then)) / 60)
    return F.when(mins < 1, "Just now").when(mins < 60, F.format_string("%dm ago", mins)).when(mins < 1440, F.format_string("%dh ago", F.floor(mins / 60))).when(mins < 10080, F.format_string("%dd ago", F.floor(mins / 1440))).otherwise(F.date_format(then, "yyyy-MM-dd"))


def html_to_text(html: Column) -> Column:
    """Without tags, five entities decoded, blanks collapsed."""
    t = F.regexp_replace(html, "<[^>]+>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return collapse_spaces(t)


def strip_fence(text: Column) -> Column:
    """JSON text without a code fence or a label before it."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    t = F.coalesce(F.nullif(F.regexp_extract(t, r"(?s)^```(?:json|JSON)?\s*(.*?)\s*```$", 1), F.lit("")), t)
    return F.coalesce(F.nullif(F.regexp_extract(t, r"(?s)^(?:json|JSON)\s*:?\s*(\{.*\})\s*$", 1), F.lit("")), t)
