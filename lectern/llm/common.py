"""Shared pieces: spilling to the cluster's shared folder, word hashing, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges that one task contracts at a time.
EDGES = 1_000_000

#: Texts that go to Python at a time, and their bytes (a longer text goes alone).
TEXT_ROWS, TEXT_BYTES = 1_000, 4 << 20

#: Bytes of text whose words are found at a time.
HASHED = 1 << 19

_MASK = (1 << 64) - 1


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder; on a cluster that is an error, since
    executors would not see each other's files.
    """
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="lectern-")
    return _LOCAL[app]


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def spill(df: DataFrame, clean: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    The result has no lineage, so that a lost executor costs a re-read and not a re-computation. With `clean`
    the shuffle files that were needed to write it go at once, and not when the driver collects garbage.
    """
    path = f"{shared_dir(df.sparkSession)}/spill-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    was = conf.get(_CLEAN, None)
    if clean:
        conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        if clean:
            conf.unset(_CLEAN) if was is None else conf.set(_CLEAN, was)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame) -> None:
    """Have texts go to Python at most TEXT_ROWS or about TEXT_BYTES at a time, in this session, from now on.

    Spark's own numbers suit narrow rows; of whole texts so many fill the memory of a small executor
    several times over, in the JVM's buffers and in Python. Smaller settings stay.
    """
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", TEXT_BYTES)):
        now = int(conf.get(name).rstrip("b"))
        if now > most or now <= 0:
            conf.set(name, str(most))


def give_back() -> None:
    """At the end of a Python task: hand freed memory to the system, since idle workers live on."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def tidy(run):
    """A function for mapInArrow that gives memory back when its task ends."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def drop_spill(*frames: DataFrame) -> None:
    """Remove spilled tables that nothing will read again."""
    for df in frames:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        root = shared_dir(spark)
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for folder in folders:
            if folder.rsplit("/", 1)[1].startswith("spill-") and root.split(":", 1)[-1].lstrip("/") in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """n odd 64-bit multipliers, the same on every machine."""
    with np.errstate(over="ignore"):
        base = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt) * np.uint64(1 << 20)) * np.uint64(0x9E3779B97F4A7C15)
        return mix64(base) | np.uint64(1)


_BYTE = seeds(256, 77)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_P = 0x100000001B3 * 0x9E3779B97F4A7C15 & _MASK | 1
_POW = np.ones(1 << 12, np.uint64)
with np.errstate(over="ignore"):
    for _i in range(1, len(_POW)):
        _POW[_i] = _POW[_i - 1] * np.uint64(_P)


def _hashed(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of a piece of text that no word leaves."""
    gap = np.concatenate(([True], _SPACE[buf], [True]))
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    starts, lens = edge[0::2], edge[1::2] - edge[0::2]
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        letters = _BYTE[buf[~gap[1:-1]]]
        first = np.concatenate(([0], np.cumsum(lens)[:-1]))
        at = np.arange(len(letters), dtype=np.int32 if len(letters) < 1 << 31 else np.int64)
        at -= np.repeat(first.astype(at.dtype), lens)
        letters *= _POW[at & 4095]
        if len(lens) and lens.max() > 4096:
            letters += (at >> 12).astype(np.uint64)
        return starts, mix64(np.add.reduceat(letters, first) + lens.astype(np.uint64))


def hash_words(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and the offsets at which each text's words start.

    Words are maximal runs of bytes other than x20 and x09-x0D in UTF-8; A-Z count as a-z. A null
    text has no words. Work goes in pieces of about HASHED bytes that end between words, so memory
    beyond the result doesn't grow with a text's length.
    """
    parts = [b"" if t is None else t.encode("utf-8", "surrogatepass").lower() for t in texts]
    ends_of_text = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    buf = np.frombuffer(b"\n".join(parts), np.uint8)
    starts, hashes, a = [], [], 0
    while a < len(buf):
        z = min(len(buf), a + HASHED)
        while z < len(buf):  # on to the next gap
            gap = np.flatnonzero(_SPACE[buf[z : z + 4096]])
            z = min(len(buf), z + int(gap[0]) if len(gap) else z + 4096)
            if len(gap):
                break
        at, made = _hashed(buf[a:z])
        starts.append(at + a)
        hashes.append(made)
        a = z
    if not starts:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    offsets = np.concatenate(([0], np.searchsorted(np.concatenate(starts), ends_of_text))).astype(np.int64)
    return np.concatenate(hashes), offsets


def hash_shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words of one text; of the whole text if it has fewer but some."""
    n = len(words)
    if not n:
        return words
    with np.errstate(over="ignore"):
        if n < k:
            out = np.full(1, n, np.uint64)
            for w in words:
                out = mix64(out * np.uint64(_P) + w)
            return out
        out = words[: n - k + 1].copy()
        for j in range(1, k):
            out *= np.uint64(_P)
            out += words[j : n - k + 1 + j]
        return mix64(out)


def text_batches(texts: list, most: int = 500_000):
    """Slices of texts with about `most` characters each, at least one text in each."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _contract(batches):
    """Of the edges of one task: each id with the smallest one that they connect it to."""
    got = [(np.asarray(x.column(0)), np.asarray(x.column(1))) for x in batches if len(x)]
    if not got:
        return
    a, b = (np.concatenate(x) for x in zip(*got, strict=True))
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, low = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while True:  # hook the roots of each edge on the smaller one, then point everything at its root
        p, q = low[x], low[y]
        if (p == q).all():
            break
        np.minimum.at(low, np.maximum(p, q), np.minimum(p, q))
        while (low[low] != low).any():
            low = low[low]
    rest = np.flatnonzero(low != np.arange(len(ids)))
    yield pa.RecordBatch.from_arrays([pa.array(ids[rest]), pa.array(ids[low[rest]])], names=["a", "b"])


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest id reachable, for each id in edges (a, b): columns id, component.

    Edges are contracted in parts of about EDGES: each part leaves its ids' links to the smallest one
    that the part connects them to. While there are several parts, a large-star and a small-star step
    over all edges follow (aggregations and joins, so no id's neighbours meet in one row), and parts
    are contracted again, until nothing changes; with one part nothing is left to do. Null ends and
    loops are dropped; ids without an edge don't appear.
    """
    e, last = spill(edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).where("a > b")), None
    while True:
        parts = max(1, -(-e.count() // EDGES))
        stars = spill(e.coalesce(parts).mapInArrow(_contract, "a long, b long"))
        drop_spill(e)
        e = stars
        if parts == 1:
            break
        mark = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(mark) == last:
            break
        last = tuple(mark)
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(small.select("a", F.col("m").alias("b"))).distinct()
        e = spill(small)
        drop_spill(stars)
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def link_forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Indices of links a[i]-b[i] between 0..n-1 that join what earlier ones leave apart."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append(i)
    return np.array(kept, np.int64)
