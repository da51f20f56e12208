"""Audits of tables and records: expected counts, quarantine, segments, cards, decisions. Codes, no exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import collapse_spaces
from lectern.operators.gates import first_reason, issues

# fixed values: headings that say nothing about a section, and those of reference lists
WEAK_HEADINGS = ["background", "discussion", "method", "result", "general", "unknown"]
REFERENCE_HEADINGS = ["references", "bibliography", "works cited"]


def chosen(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Rows whose column is one of the names; a name that no row has is an error."""
    rows = df.where(F.col(column).isin(names))
    found = {r[0] for r in rows.select(column).distinct().collect()}  # at most as many as names
    unknown = sorted(set(names) - found)
    if unknown:
        raise ValueError(f"unknown {column}: {', '.join(unknown)}")
    return rows


def expected_counts(df: DataFrame, by: str, expected: DataFrame) -> DataFrame:
    """by, expected, n and ok of each group of df or of expected (by, expected); what one side lacks counts as 0."""
    n = df.groupBy(by).agg(F.count("*").alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    j = n.join(expected, by, "full_outer").select(by, zero("expected"), zero("n"))
    return j.withColumn("ok", F.col("n") == F.col("expected"))


def quarantine_audit(rows: DataFrame, source: DataFrame, key: list[str], reason: str, stage: str, most: int = 20, width: int = 140) -> DataFrame:
    """kind, name, n: rows that the source lacks and rows beyond the first of a key (kind issue), last stages,
    and the `most` commonest reasons by their first `width` characters."""
    per = rows.groupBy(*key).agg(F.count("*").alias("n"))  # a hot key meets as one row from each task
    lost = per.join(source.select(*key).distinct(), key, "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("not_in_source").alias("name"), "n")
    again = per.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n")).select(F.lit("duplicate_source").alias("name"), "n")
    count = lambda c: rows.groupBy(F.coalesce(c, F.lit("")).alias("name")).agg(F.count("*").alias("n"))
    reasons = count(F.left(F.col(reason), F.lit(width))).orderBy(F.desc("n"), "name").limit(most)
    parts = {"issue": lost.unionAll(again), "stage": count(F.col(stage)), "reason": reasons}
    out = None
    for kind, part in parts.items():
        part = part.select(F.lit(kind).alias("kind"), "name", "n")
        out = part if out is None else out.unionAll(part)
    return out


def segment_issues(segments: Column, sentences: Column, keep_references: bool = False) -> Column:
    """Codes of what is wrong with a document's segments (segment_id, content, word_count, sentence_ids).

    sentences: (sentence_id, word_count, is_reference). Ids must count from 1; stated word counts must be
    those of the contents; sentence ids must rise inside and across segments, and cover all sentences but
    references once; contents must differ; words in all may differ by 5 % or 3 words.
    """
    ids = F.flatten(F.transform(segments, lambda s: s["sentence_ids"]))
    wanted = sentences if keep_references else F.filter(sentences, lambda s: ~s["is_reference"])
    known = F.transform(wanted, lambda s: s["sentence_id"])
    total = lambda items: F.aggregate(items, F.lit(0).cast("long"), lambda a, s: a + s["word_count"])
    ends = F.transform(segments, lambda s: F.struct(F.element_at(s["sentence_ids"], 1).alias("first"), F.element_at(s["sentence_ids"], -1).alias("last")))
    crossed = F.transform(ends, lambda e, i: (i > 0) & (e["first"] <= F.get(ends, i - 1)["last"]))
    plain = F.transform(segments, lambda s: F.lower(collapse_spaces(s["content"])))
    return issues({
        "segment_ids": F.exists(F.transform(segments, lambda s, i: s["segment_id"] != i + 1), lambda x: x),
        "empty_content": F.exists(segments, lambda s: F.trim(s["content"]) == ""),
        "word_count": F.exists(segments, lambda s: s["word_count"] != F.regexp_count(s["content"], F.lit(r"\S+"))),
        "no_sentences": F.exists(segments, lambda s: F.size(s["sentence_ids"]) == 0),
        "not_increasing": F.exists(segments, lambda s: s["sentence_ids"] != F.array_sort(F.array_distinct(s["sentence_ids"]))),
        "range_order": F.exists(crossed, lambda x: x),
        "duplicate_content": F.size(F.array_distinct(plain)) < F.size(plain),
        "duplicated_sentences": F.size(F.array_distinct(ids)) < F.size(ids),
        "missing_sentences": F.size(F.array_except(known, ids)) > 0,
        "unexpected_sentences": F.size(F.array_except(ids, known)) > 0,
        "total_words": F.abs(total(segments) - total(wanted)) > F.greatest(F.lit(3), F.floor(total(wanted) * 0.05)),
    })


def card_issue(viewpoint: Column, summary: Column) -> Column:
    """Why a section's card is rejected: empty parts, a heading that says nothing, links or citations. Null if it isn't."""
    v, s = F.trim(collapse_spaces(F.coalesce(viewpoint, F.lit(""))), F.lit(" .")), collapse_spaces(F.coalesce(summary, F.lit("")))
    return first_reason({
        "empty_viewpoint": v == "",
        "empty_summary": s == "",
        "generic_viewpoint": F.lower(v).isin(WEAK_HEADINGS + REFERENCE_HEADINGS),
        "link_or_citation": F.concat_ws(" ", v, s).rlike(r"https?://|www\.|\[[^\]]+\]"),
    })


def notice(used_fallback: Column, reasons: Column) -> Column:
    """What a reader is told, as a code: processed, or the gravest of the fallback reasons."""
    has = lambda r: F.array_contains(reasons, r)
    rules = {"processed": ~used_fallback, "not_segmented": has("preprocessing_failed"), "segmented_locally": has("local_segmentation_fallback") | has("ai_segmentation_failed"), "partly_local": has("partial_ai_segmentation_failed")}
    return F.coalesce(first_reason(rules), F.lit("basic_result"))


def segmentation_source(mode: Column, used_fallback: Column, reason: Column) -> Column:
    """Where segments come from, by the mode, whether a fallback was used, and its reason."""
    rules = {
        "ai": mode.isin("sentence_range", "chunked_sentence_range") & ~used_fallback,
        "local_fallback": mode == "local_fallback",
        "mixed": mode == "chunked_mixed_fallback",
        "single_block_fallback": reason == "preprocessing_failed",
        "none": reason == "empty_text",
    }
    return F.coalesce(first_reason(rules), F.lit("unknown"))


def assistant_features(prompt: Column, answer: Column, most: int, ignored: int = -100) -> Column:
    """(input_ids, labels, prompt_tokens, truncated) of token arrays: labels are the answer's, cut at `most` together."""
    full, p = F.concat(prompt, answer), F.size(prompt)
    labels = F.concat(F.array_repeat(F.lit(ignored), p), answer)
    return F.struct(F.slice(full, 1, most).alias("input_ids"), F.slice(labels, 1, most).alias("labels"), F.least(p, F.lit(most)).alias("prompt_tokens"), (F.size(full) > most).alias("truncated"))


def padded(ids: Column, width: Column, value: int) -> Column:
    """ids followed by `value` up to the width."""
    return F.concat(ids, F.array_repeat(F.lit(value), F.greatest(F.lit(0), width - F.size(ids)).cast("int")))


def batch_width(longest: Column, multiple: int = 8) -> Column:
    """The longest of a batch rounded up to a multiple."""
    return (F.ceil(longest / multiple) * multiple).cast("int")
