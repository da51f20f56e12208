"""Document quality: a classifier's evidence with host and path posteriors, by hierarchical empirical Bayes."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import give_back, small_batches, spill, tidy

#: Most labelled rows that the classifier is fitted on, those with the least hash of doc_id.
SAMPLE = 5_000
STEPS, RIDGE = 40, 1.0
#: Weight of a path's log-odds beside the document's own.
PATH_WEIGHT = 0.25
#: Bounds of the prior's weight in documents.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1e6

_CLASS = np.zeros(256, np.int64)  # 0 other, 1 letter, 2 blank, 3 digit, 4 sentence mark, 5 other ASCII mark, 6 capital
_CLASS[list(b"abcdefghijklmnopqrstuvwxyz") + list(range(128, 256))] = 1
_CLASS[list(b" \t\n\r\x0b\x0c")] = 2
_CLASS[list(b"0123456789")] = 3
_CLASS[list(b".,;:'\"()-?")] = 4
_CLASS[list(b"#$%&*|<>=@[]\\^_`{}~+/!")] = 5
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 6

FEATURES = ("words", "distinct", "commonest", "repeats", "capitals", "digits", "marks", "odd marks", "word length", "line length")


def features(text: str | None) -> list[float]:
    """Shape of a whole text; a null text counts as empty."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n, size = len(words), max(1, len(data))
    kinds = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=7) / size
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    m = max(1, n)
    # long texts repeat words by nature, so distinct words are held against a power of the length
    return [np.log1p(n), np.log1p(len(counts)) - 0.75 * np.log1p(n), max(counts.values(), default=0) / m, again / m, kinds[6], kinds[3], kinds[4], kinds[5], np.log1p(size / m), np.log1p(size / (1 + data.count(b"\n")))]


class Classifier:
    """Ridge logistic regression over features and their squares, by Newton's method."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
        z = self._wide(x)
        self.weights = np.zeros(z.shape[1])
        for _ in range(STEPS if len(x) else 0):
            p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
            ridge = np.full(z.shape[1], RIDGE)
            ridge[0] = 1e-3
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * self.weights)
            self.weights -= step
            if np.abs(step).max() < 1e-6:
                break

    def _wide(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x.reshape(-1, len(FEATURES)) - self.mean) / self.scale, -6, 6)
        return np.hstack([np.ones((len(z), 1)), z, z * z])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._wide(x) @ self.weights, -12, 12)


def fit(docs: DataFrame, labels: DataFrame) -> Classifier:
    """From SAMPLE labelled documents at most; null ids or labels teach nothing."""
    small_batches(docs)
    y = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("quality"))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = docs.select("doc_id", "text").join(F.broadcast(y), "doc_id").select("doc_id", "text", "quality")

    def shape(batches):
        for b in batches:
            made = [features(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.list_(pa.float64())), b.column(2)], names=["doc_id", "x", "y"])

    got = sorted(rows.mapInArrow(tidy(shape), "doc_id long, x array<double>, y int").collect())
    return Classifier(np.array([r.x for r in got]).reshape(-1, len(FEATURES)), np.array([float(r.y > 0) for r in got]))


def _logits(docs: DataFrame, model, columns: list[str]) -> DataFrame:
    """The columns, in which text may be one, and __logit; model: a broadcast classifier.

    Only texts go to Python and only logits come back; the rows wait in the JVM.
    """

    @F.arrow_udf("double")
    def logit(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            x = np.array([features(t.as_py()) for t in texts])
            yield pa.array(model.value.logit(x) if len(x) else [], pa.float64())
        give_back()

    return docs.select(*[F.col(f"`{c}`") for c in columns], logit("text").alias("__logit"))


def strength_of(groups: DataFrame, parent: list[str]) -> DataFrame:
    """strength, of one row: how many documents' weight a Beta prior over the groups' rates has, by moments.

    groups: t, q, n (sum, sum of squares and number of each group's values in 0..1) and the parent that
    a group belongs to. The variance between the groups of a parent is what the spread of their means has
    beyond the values' own variance within groups (analysis of variance); a Beta prior of mean g and
    that variance v has the weight g (1 - g) / v - 1. It is kept within LEAST_STRENGTH and
    MOST_STRENGTH; where groups don't differ beyond chance, or no parent has two, it is the latter.
    """
    t, n = F.col("t"), F.col("n")
    a = groups.groupBy(*parent).agg(F.count("*").alias("k"), F.sum(n).alias("m"), F.sum(t).alias("s"), F.sum(t * t / n).alias("b"), F.sum(F.col("q") - t * t / n).alias("w"), F.sum(n * n).alias("nn"))
    own = F.col("b") - F.col("s") * F.col("s") / F.col("m")
    a = a.agg(F.sum(F.col("k") - 1).alias("k"), F.sum("m").alias("m"), F.sum("s").alias("s"), F.sum(own).alias("b"), F.sum("w").alias("w"), F.sum(F.col("m") - F.col("nn") / F.col("m")).alias("c"), F.sum("k").alias("all"))
    g = F.col("s") / F.col("m")
    within = F.when(F.col("m") > F.col("all"), F.greatest(F.col("w"), F.lit(0.0)) / (F.col("m") - F.col("all"))).otherwise(0.0)
    between = F.when(F.col("k") > 0, (F.col("b") - F.col("k") * within) / F.col("c"))
    made = F.when(between > 1e-12, g * (1 - g) / between - 1).otherwise(F.lit(MOST_STRENGTH))
    return a.select(F.greatest(F.lit(LEAST_STRENGTH), F.least(F.lit(MOST_STRENGTH), made)).alias("strength"))


def _sites(scored: DataFrame) -> DataFrame:
    """__h, __t, host_rate, path_rate, __shift from the logits of all documents of each site."""
    p = 1 / (1 + F.exp(-F.col("__logit")))
    site = spill(scored.groupBy("__h", "__t").agg(F.sum(p).alias("s"), F.sum(p * p).alias("q"), F.count("*").alias("n")))
    hosts = site.groupBy(F.col("__h").alias("__hh")).agg(F.sum("s").alias("hs"), F.sum("q").alias("hq"), F.sum("n").alias("hn"))
    every = hosts.agg((F.sum("hs") / F.sum("hn")).alias("g"))
    above = strength_of(hosts.select(F.col("hs").alias("t"), F.col("hq").alias("q"), F.col("hn").alias("n")), []).select(F.col("strength").alias("hm"))
    below = strength_of(site.select("__h", F.col("s").alias("t"), "q", "n"), ["__h"]).select(F.col("strength").alias("pm"))
    one = spill(every.crossJoin(above).crossJoin(below))  # each of these has one row
    hosts = hosts.crossJoin(F.broadcast(one)).withColumn("host_rate", (F.col("hs") + F.col("hm") * F.col("g")) / (F.col("hn") + F.col("hm")))
    site = site.join(hosts, F.expr("__h <=> __hh"))
    site = site.withColumn("path_rate", (F.col("s") + F.col("pm") * F.col("host_rate")) / (F.col("n") + F.col("pm")))
    odds = lambda c: F.log(F.col(c) / (1 - F.col(c)))
    return spill(site.select("__h", "__t", "host_rate", "path_rate", (PATH_WEIGHT * (odds("path_rate") - odds("g"))).alias("__shift")))


def _rated(docs: DataFrame, labels: DataFrame, host: str, path: str, columns: list[str]) -> DataFrame:
    """The columns with logit, rates and quality; each text is looked at once, and its row written with its logit."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    site = docs.withColumns({"__h": F.col(host).cast("string"), "__t": F.col(path).cast("string")})
    scored = spill(_logits(site, model, [*columns, "__h", "__t"]))
    rates = _sites(scored).select(F.col("__h").alias("__rh"), F.col("__t").alias("__rt"), F.col("host_rate").alias("__host"), F.col("path_rate").alias("__path"), "__shift")
    out = scored.join(rates, F.expr("__h <=> __rh and __t <=> __rt"))
    return out.withColumn("__quality", 1 / (1 + F.exp(-(F.col("__logit") + F.col("__shift")))))


def quality_scores(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, host, path, logit, host_rate, path_rate, quality (0 to 1) and accepted.

    The classifier, fitted on a bounded sample of labelled documents, gives each document a logit.
    The sum of its probabilities over all documents is the global rate; a host's posterior mean
    shrinks its own rate to the global one, a path's (host and path) to its host's likewise, so sparse
    sites follow what is above them. How strongly is estimated from the sites (`strength_of`), for
    hosts and for paths. The final logit adds what the path's posterior says beyond the global rate,
    with PATH_WEIGHT, since the path's rate is itself made of these documents. Accepted: quality of one
    half or more.

    Documents here have a source and a language for host and path; any two columns will do. Null
    hosts or paths form a site of their own. Null and empty texts are scored by their shape. Without
    labels every classifier logit is 0, and quality one half: all are accepted. Null doc_ids and
    repeated rows are scored each; other columns are ignored; no rows give no rows. Sites are found
    by partial aggregation, so a hot one is no burden; their rates are broadcast only where Spark
    finds them small.
    """
    out = _rated(docs, labels, host, path, ["doc_id"])
    return out.select("doc_id", F.col("__h").alias("host"), F.col("__t").alias("path"), F.col("__logit").alias("logit"), F.col("__host").alias("host_rate"), F.col("__path").alias("path_rate"), F.col("__quality").alias("quality"), (F.col("__quality") >= 0.5).alias("accepted"))


def accepted_documents(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """The rows of docs that quality_scores accepts, with all their columns; texts aren't shuffled."""
    return _rated(docs, labels, host, path, docs.columns).where("__quality >= 0.5").select(*[f"`{c}`" for c in docs.columns])
