"""Near-duplicate documents by min-max hashing, with links confirmed on full shingle sets."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import connected_components, drop_spill, give_back, hash_shingles, hash_words, link_forest, mix64, seeds, small_batches, spill, text_batches, tidy

#: Most shingles and documents that one task compares at a time; larger groups go in blocks.
BLOCK_SHINGLES = 1_000_000
BLOCK_DOCS = 1_000
#: Bands that vote for a large group's leader.
LEADER_BANDS = 6
#: Parts in which the copies of one set look up their representative.
SALTS = 16


def _sets(texts: list, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    words, at = hash_words(texts)
    return [np.unique(hash_shingles(words[at[i] : at[i + 1]], k)) for i in range(len(texts))], at


def _bands(sets: list[np.ndarray], bands: int, perms: int) -> np.ndarray:
    """Band keys, documents x bands. Each permutation gives its minimum and its maximum."""
    full = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    keys = np.zeros((len(sets), bands), np.uint64)
    mult = seeds(bands * perms, 5)
    with np.errstate(over="ignore"):
        for b in range(bands):
            key = np.full(len(sets), b + 1, np.uint64)
            for a in mult[b * perms : (b + 1) * perms]:
                v = full * a
                v ^= v >> np.uint64(29)
                for least in (np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts)):
                    key = mix64(key * np.uint64(0x100000001B3) + least)
            keys[:, b] = key
    return keys


def signatures(docs: DataFrame, k: int, bands: int, perms: int) -> DataFrame:
    """doc_id, form (hash of the text), n_shingles, digest of the shingle set, band keys; empty sets have no digest or keys."""

    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, z in text_batches(texts):
                sets, _ = _sets(texts[a:z], k)
                n = np.array([len(s) for s in sets], np.int64)
                some = [s for s in sets if len(s)]
                keys = iter(_bands(some, bands, perms).view(np.int64)) if some else iter(())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, z - a),
                        batch.column(1).slice(a, z - a),
                        pa.array(n),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "form", "n_shingles", "digest", "bands"],
                )

    return docs.select("doc_id", "form", "text").mapInArrow(tidy(run), "doc_id long, form long, n_shingles long, digest binary, bands array<long>")


def linked_pairs(sets: list[np.ndarray], percent: int, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of sets with 100 * intersection >= percent * union; rows: only with one i there.

    Intersections are counted over an inverted index of the shingles that two sets share: rare ones
    by enumerating their pairs, frequent ones as products of 0/1 matrices.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    df = np.diff(np.concatenate((starts, [len(flat)])))
    both = np.zeros(n * n, np.int64)
    for d in np.unique(df[(df > 1) & (df <= 24)]):
        of = owner[starts[df == d][:, None] + np.arange(d)]
        i, j = np.triu_indices(d, 1)
        both += np.bincount((of[:, i] * n + of[:, j]).ravel(), minlength=n * n)
    both = both.reshape(n, n)
    dense = np.flatnonzero(df > 24)
    for a in range(0, len(dense), 2048):
        part = dense[a : a + 2048]
        x = np.zeros((n, len(part)), np.float32)
        at = np.concatenate([np.arange(starts[p], starts[p] + df[p]) for p in part])
        x[owner[at], np.repeat(np.arange(len(part)), df[part])] = 1
        both += np.triu((x @ x.T).astype(np.int64), 1)
    hit = both * 100 >= percent * (size[:, None] + size[None, :] - both)
    hit &= both > 0
    if rows is not None:
        hit &= rows[:, None] != rows[None, :]
    return np.nonzero(np.triu(hit, 1))


def _edges_of(k: int, percent: int):
    """A function for applyInArrow over groups: edges that join the group's linked sets."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("node").to_numpy()
        side = table.column("side").to_numpy()
        sets: list[np.ndarray] = []
        texts = table.column("text")
        sizes = np.concatenate([np.asarray(pc.binary_length(c)) for c in texts.chunks]) if len(texts) else np.zeros(0, np.int64)
        start = 0
        while start < len(ids):  # some texts at a time become Python strings
            stop = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), 500_000)))
            sets += _sets(texts.slice(start, stop - start).to_pylist(), k)[0]
            start = stop
        i, j = linked_pairs(sets, percent, side if side.any() else None)
        keep = link_forest(i, j, len(ids))
        give_back()
        return pa.table({"a": ids[i[keep]], "b": ids[j[keep]]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return run


def _leaders(reps: DataFrame, large: DataFrame) -> DataFrame:
    """cid, node: of each large group the set whose band keys are most often the group's most frequent ones."""
    bands = large.select("cid", "node").join(reps.select("node", F.posexplode(F.slice("bands", 1, LEADER_BANDS)).alias("band", "key")), "node")
    n = bands.groupBy("cid", "band", "key").agg(F.count("*").alias("n"))
    mode = n.groupBy("cid", "band").agg(F.max_by("key", F.struct("n", "key")).alias("key"))
    agree = bands.join(mode, ["cid", "band", "key"]).groupBy("cid", "node").agg(F.count("*").alias("n"))
    return agree.groupBy("cid").agg(F.max_by("node", F.struct("n", -F.col("node"))).alias("node"))


def _linked_sets(docs: DataFrame, k: int, percent: int, bands: int, perms: int) -> tuple[DataFrame, bool]:
    """doc_id, form, n_shingles, component of each distinct row, and whether a doc_id has several sets.

    docs: doc_id, form, text. A set is a node of the graph, under its doc_id, or under a hash of doc_id
    and digest where one doc_id has several sets. component is the least node that a set's links reach;
    null for an empty set.
    """
    sigs = spill(signatures(docs, k, bands, perms))
    some = sigs.where("digest is not null")
    several = spill(some.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select(F.col("doc_id").alias("sid")))
    mixed = bool(several.limit(1).count())
    node = F.when(F.col("sid").isNotNull(), F.xxhash64("doc_id", "digest")).otherwise(F.col("doc_id"))
    some = some.join(several, F.col("doc_id") == F.col("sid"), "left").withColumn("node", node).drop("sid")
    # copies of one set may be a third of all rows: their join is dealt out by the form of the text and a salt
    copies = some.groupBy("digest").agg(F.min(F.struct("doc_id", "node")).alias("r"), F.count("*").alias("n")).where("n > 1")
    copies = copies.select(F.col("digest").alias("cd"), F.col("r.node").alias("rep"), F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")).alias("cs"))
    salted = some.withColumn("salt", F.pmod(F.xxhash64("doc_id", "node"), F.lit(SALTS)))
    named = spill(salted.join(copies, F.expr("digest = cd and salt = cs"), "left").select("doc_id", "form", "n_shingles", "node", F.coalesce("rep", "node").alias("rep"), F.when(F.coalesce("rep", "node") == F.col("node"), F.col("bands")).alias("bands")))
    reps = spill(named.where("bands is not null").dropDuplicates(["node"]))
    keyed = reps.select("node", F.explode("bands").alias("key"))
    first = keyed.groupBy("key").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").select("key", "b")
    near = connected_components(keyed.join(first, "key").select(F.col("node").alias("a"), "b"))
    member = spill(near.select(F.col("id").alias("node"), F.col("component").alias("cid")).join(reps.select("node", "doc_id", "form", "n_shingles"), "node"))
    blocks = F.greatest(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_DOCS)).cast("long")
    groups = spill(member.groupBy("cid").agg(blocks.alias("m")))
    member = member.join(groups, "cid")
    block = F.when(F.col("m") > 1, F.pmod(F.xxhash64("node"), F.col("m"))).otherwise(0)
    large = member.where("m > 1")
    has_large = bool(groups.where("m > 1").limit(1).count())
    task = member.select("node", "doc_id", "form", "cid", block.alias("block"), F.lit(0).alias("side"))
    if has_large:
        leader = _leaders(reps, large).join(member.select("node", "doc_id", "form", "cid", "m"), ["cid", "node"])
        leader = leader.select("node", "doc_id", "form", "cid", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("block"), F.lit(0).alias("side"))
        task = task.unionAll(leader).dropDuplicates(["node", "cid", "block"])
    again = bool(sigs.groupBy("doc_id", "form").count().where("count > 1").limit(1).count())  # rows that repeat

    def confirm(task: DataFrame) -> DataFrame:
        rows = task.join(docs, ["doc_id", "form"]).select("cid", "block", "node", "side", "text")
        if again:
            rows = rows.dropDuplicates(["cid", "block", "node", "side"])
        return rows.groupBy("cid", "block").applyInArrow(_edges_of(k, percent), "a long, b long")

    edges = spill(confirm(task))
    linked = connected_components(edges)
    if has_large:
        comp = large.join(linked.withColumnRenamed("id", "node"), "node", "left").select("node", "doc_id", "form", "cid", "m", F.coalesce("component", "node").alias("component"))
        comp = spill(comp)
        sizes = comp.groupBy("cid", "component").agg(F.count("*").alias("n"))
        main = sizes.groupBy("cid").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("main"))
        rest = comp.join(main, "cid").where("component <> main")
        width = rest.groupBy("cid").agg(F.ceil(F.count("*") / BLOCK_DOCS).cast("long").alias("w"))
        rest = rest.join(width, "cid").withColumn("u", F.pmod(F.xxhash64("node", F.lit(1)), F.col("w")))
        left = rest.select("node", "doc_id", "form", "cid", "m", "u", F.explode(F.expr("sequence(0L, m - 1)")).alias("v"), F.lit(1).alias("side"))
        right = comp.join(width, "cid").select("node", "doc_id", "form", "cid", "m", F.explode(F.expr("sequence(0L, w - 1)")).alias("u"), F.pmod(F.xxhash64("node"), F.col("m")).alias("v"), F.lit(2).alias("side"))
        cross = left.unionAll(right).select("node", "doc_id", "form", "cid", F.struct("u", "v").alias("block"), "side")
        more = spill(confirm(cross))
        linked = connected_components(edges.unionAll(more))
        drop_spill(comp, more)
    sets = named.join(linked.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", "form", "n_shingles", F.coalesce("component", "rep").alias("component"))
    empty = sigs.where("digest is null").select("doc_id", "form", "n_shingles", F.lit(None).cast("long").alias("component"))
    out = spill(sets.unionAll(empty).distinct())
    drop_spill(sigs, several, named, reps, member, groups, edges)
    return out, mixed


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("binary")).alias("form"), F.col(text).alias("text")).where("doc_id is not null")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 24, perms: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept.

    Words are runs other than x20 and x09-x0D of the text with A-Z in lower case; a document's set
    has its distinct runs of k words, or with fewer words the whole sequence. Documents link when
    100 * intersection >= percent * union. Min-max hashing keeps the least and the greatest value
    under each of bands * perms permutations; a band is 2 * perms of them. 24 bands of 4 miss a pair
    at similarity 0.8 with probability 3e-6, at 0.85 with 2e-8.

    Equal sets collapse first. Sets that share a band key with the smallest one there form candidate
    groups; within a group all pairs are confirmed on full sets, in blocks where the group is large. A
    large group's blocks are each compared inside and with the group's leader; then only sets outside
    the group's main component meet the other blocks.

    A null or empty text, or one without words, has 0 shingles and no links. Null doc_ids are
    dropped. Rows that repeat a doc_id give one row if their sets are equal, else one for each size of
    set, and a link of any of them is a link of the doc_id. Other columns are ignored. An empty table
    gives no rows.
    """
    small_batches(docs)
    sets, mixed = _linked_sets(_keyed(docs, doc_id, text), k, percent, bands, perms)
    if mixed:
        # sets of one doc_id are one document: their components join, and go by the least doc_id
        one = sets.where("component is not null").groupBy("doc_id").agg(F.min("component").alias("lo"))
        edges = sets.join(one, "doc_id").where("component <> lo").select(F.col("component").alias("a"), F.col("lo").alias("b"))
        joined = connected_components(edges).select(F.col("id").alias("component"), F.col("component").alias("to"))
        sets = sets.join(joined, "component", "left").select("doc_id", "n_shingles", F.coalesce("to", "component").alias("component"))
        least = sets.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
        whole = sets.groupBy("doc_id").agg(F.min("component").alias("component")).join(least, "component", "left").select("doc_id", "least")
        sets = sets.select("doc_id", "n_shingles").distinct().join(whole, "doc_id").withColumnRenamed("least", "component")
    out = sets.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).distinct()
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def one_of_each_group(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 24, perms: int = 2) -> DataFrame:
    """The rows of docs without those that near-duplicate, through links, a row of a smaller doc_id.

    As `near_duplicates`, but rows that repeat a doc_id with other texts are documents of their own;
    of equal rows one stays. Rows without a doc_id or without words all stay, with all their columns.
    """
    small_batches(docs)
    sets, mixed = _linked_sets(_keyed(docs, "doc_id", "text"), k, percent, bands, perms)
    sets = sets.where("component is not null")
    first = sets.groupBy("component").agg(F.min(F.struct("doc_id", "form")).alias("f"))
    first = spill(first.select(F.col("f.doc_id").alias("fd"), F.col("f.form").alias("ff")))
    gone = sets.select(F.col("doc_id").alias("gd"), F.col("form").alias("gf")).join(first, F.expr("gd = fd and gf = ff"), "left_anti")
    form = F.xxhash64(F.col("text").cast("binary"))
    rows = docs.where("doc_id is not null").withColumn("__form", form)
    kept = rows.join(gone, F.expr("doc_id = gd and __form = gf"), "left_anti").dropDuplicates(["doc_id", "__form"]).drop("__form")
    return kept.select(docs.columns).unionAll(docs.where("doc_id is null"))
