"""Reading segments with extractive summaries."""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.cuts import segments

_TOKEN = re.compile(r"[a-z][a-z'-]*")


def summarise(sentences: list[tuple[str, bool]], most: int = 2) -> str:
    """The sentences that together cover the segment's terms best, in their order, neighbours only if need be.

    A term weighs as often as it occurs, less the more sentences hold it, so words that are everywhere
    count little. Sentences are taken one by one by the weight of terms that no chosen one has, for the
    root of their length; those with a link come last.
    """
    body = [s for s, heading in sentences if not heading]
    terms = [Counter(_TOKEN.findall(s.lower())) for s in body]
    held = Counter(t for c in terms for t in c)
    count: Counter = Counter()
    for c in terms:
        count.update(c)
    weight = {t: n * math.log(1 + len(body) / held[t]) for t, n in count.items()}
    linked = ["http" in s or "www." in s for s in body]
    chosen: list[int] = []
    covered: set[str] = set()
    while len(chosen) < min(most, len(body)):
        left = [i for i in range(len(body)) if i not in chosen]
        apart = [i for i in left if all(abs(i - j) > 1 for j in chosen)] or left
        gain = {i: sum(weight[t] for t in terms[i] if t not in covered) / math.sqrt(1 + terms[i].total()) for i in apart}
        best = min(apart, key=lambda i: (linked[i], -gain[i], i))
        chosen.append(best)
        covered |= set(terms[best])
    return " ".join(body[i] for i in sorted(chosen))


def segment_documents(docs: DataFrame) -> DataFrame:
    """Segments of each text (`cuts.segments`) with an extractive summary; null or blank texts have none.

    The cuts are planned by Spark; only a segment's own sentences go to Python, for the summary.
    """

    @F.arrow_udf("string")
    def summary(part: pa.Array) -> pa.Array:
        return pa.array([summarise([(x["text"], x["heading"]) for x in p]) for p in part.to_pylist()], pa.string())

    d = segments(docs, parts=True)
    return d.select("doc_id", "segment_id", "first_sentence", "last_sentence", "word_count", "content", summary("part").alias("summary"))
