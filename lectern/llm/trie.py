"""Prefix trie of conversations: rolling prefix fingerprints, verified turn by turn, rolled up to parents."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import drop_spill, mix64, seeds, spill, tidy
from lectern.operators.sequences import number_rows

#: Turns of a conversation that one scan takes; a longer one is scanned in blocks, and then over blocks.
BLOCK = 4096
#: Ids that are joined in a row before their digests are made.
CHUNK = 8192

_BASE = seeds(1, 23)[0]
_POWER = np.ones(BLOCK, np.uint64)
with np.errstate(over="ignore"):
    for _i in range(1, BLOCK):
        _POWER[_i] = _POWER[_i - 1] * _BASE


def _ordered(turns: DataFrame) -> DataFrame:
    """conv, role, text, depth (from 1) of turns in order; null role and text are empty."""
    t = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return number_rows(t, ["turn", "role", "text"], by=["conv"], name="number").select("conv", (F.col("number") + 1).cast("long").alias("depth"), "role", "text")


def with_shared_heads(turns: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on shared heads: turns (conv_id, turn, role, text) and all ids (conv_id).

    Conversation c gets the first h turns of conversation c - c % group, and then its own without its first
    h; h is the CRC-32 of decimal c modulo `most`. Turns are in order of turn, null first, then role, text.
    """
    own = spill(_ordered(turns))
    ids = own.select("conv").distinct().withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % most)
    tail = own.join(ids, "conv").where("depth > h").select("conv", "depth", "role", "text")
    first = own.where(F.col("depth") < most).select(F.col("conv").alias("base"), "depth", "role", "text")
    head = ids.where("h > 0").withColumn("base", F.col("conv") - F.col("conv") % group).join(first, "base").where("depth <= h").select("conv", "depth", "role", "text")
    names = {"conv": "conv_id", "depth": "turn"}
    return tail.unionAll(head).withColumnsRenamed(names), ids.select(F.col("conv").alias("conv_id"))


def _scan(batches):
    """Of rows (conv, block, at, value, mark, ...) sorted by conv, block, at: the same with polynomial prefix sums.

    h and m sum value and mark of the block's rows up to each one, times the base to the power of their
    place; before is h without the row itself.
    """
    last, run_h, run_m = None, np.uint64(0), np.uint64(0)
    for batch in batches:
        if not len(batch):
            continue
        conv, block, at, value, mark = (np.asarray(batch.column(i)) for i in range(5))
        with np.errstate(over="ignore"):
            power = _POWER[at % BLOCK]
            terms = [mix64(value.view(np.uint64)) * power, np.where(mark == 0, np.uint64(0), mix64(mark.view(np.uint64))) * power]
            new = np.concatenate(([(int(conv[0]), int(block[0])) != last], (conv[1:] != conv[:-1]) | (block[1:] != block[:-1])))
            start = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            goes_on = np.cumsum(new) == 0
            out = []
            for x, run in zip(terms, (run_h, run_m), strict=True):
                total = np.cumsum(x)
                out.append(total - (total - x)[start] + np.where(goes_on, run, np.uint64(0)))
            before = out[0] - terms[0]
        last, run_h, run_m = (int(conv[-1]), int(block[-1])), out[0][-1], out[1][-1]
        columns = [batch.column(i) for i in (0, 1, 2)] + [pa.array(x.view(np.int64)) for x in (*out, before)] + [batch.column(i) for i in range(5, batch.num_columns)]
        yield pa.RecordBatch.from_arrays(columns, names=["conv", "block", "at", "h", "m", "before", *batch.schema.names[5:]])


_SCANNED = "conv long, block long, at long, h long, m long, before long"


def _scanned(rows: DataFrame, also: str = "") -> DataFrame:
    rows = rows.repartition("conv", "block").sortWithinPartitions("conv", "block", "at")
    return rows.mapInArrow(tidy(_scan), _SCANNED + also)


def fingerprints(turns: DataFrame, bits: int = 64) -> DataFrame:
    """conv, depth, h, m, before, words, last of turns (conv, depth, value, mark, words, last).

    h is the fingerprint of the conversation's first `depth` turns, m of their marks, before that of the turns
    before. Blocks of BLOCK turns are scanned by themselves; those after a first one also carry the scan over
    the blocks before. bits limits h (for tests).
    """
    d = turns.withColumn("block", F.expr(f"(depth - 1) div {BLOCK}"))
    scanned = spill(_scanned(d.select("conv", "block", F.expr(f"(depth - 1) % {BLOCK}").alias("at"), "value", "mark", "words", "last"), ", words long, last boolean"))
    depth = F.expr(f"block * {BLOCK} + at + 1").alias("depth")
    low = F.col("h") if bits >= 64 else F.col("h").bitwiseAND((1 << bits) - 1)
    out = scanned.where("block = 0").select("conv", depth, low.alias("h"), "m", "before", "words", "last")
    full = scanned.where(F.col("at") == BLOCK - 1)
    if full.limit(1).count():
        whole = full.select("conv", F.lit(0).cast("long").alias("block"), F.col("block").alias("at"), F.xxhash64("h", "m").alias("value"), F.lit(0).cast("long").alias("mark"))
        ahead = _scanned(whole.withColumn("block", F.expr(f"at div {BLOCK}"))).select("conv", (F.col("block") * BLOCK + F.col("at") + 1).alias("block"), F.col("h").alias("carry"))
        more = scanned.where("block > 0").join(ahead, ["conv", "block"])
        h = F.xxhash64("h", "carry") if bits >= 64 else F.xxhash64("h", "carry").bitwiseAND((1 << bits) - 1)
        out = out.unionAll(more.select("conv", depth, h.alias("h"), F.xxhash64("m", "carry").alias("m"), F.xxhash64("before", "carry").alias("before"), "words", "last"))
    out = spill(out)
    drop_spill(scanned)
    return out


def _nodes(marked: DataFrame) -> DataFrame:
    return marked.groupBy("depth", "h", "m").agg(F.min("conv").alias("owner"), F.count("*").alias("n"), F.sum(F.col("last").cast("long")).alias("ends"))


def _members(texts: DataFrame, bits: int) -> DataFrame:
    """conv, depth, owner, n, leaf, last, words: each conversation's nodes, an owner being the smallest member.

    Groups of equal depth and fingerprint are compared with their owner, turn by turn: role, text and the
    fingerprint of the turns before must be equal. Turns that differ get a mark, marks get fingerprints of
    their own, and groups are made and compared anew until none differs; equal prefixes always get equal marks.
    """
    size = F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long")
    most = texts.groupBy("conv").agg(F.max("depth").alias("length"))
    light = texts.select("conv", "depth", F.xxhash64("role", "text").alias("value"), size.alias("words")).join(most, "conv")
    light = spill(light.select("conv", "depth", "value", "words", (F.col("depth") == F.col("length")).alias("last"), F.lit(0).cast("long").alias("mark")))
    while True:
        marked = fingerprints(light, bits)
        nodes = _nodes(marked)
        member = marked.join(nodes, ["depth", "h", "m"]).select("conv", "depth", "h", "m", "before", "owner", "n", (F.col("ends") == F.col("n")).alias("leaf"), "last", "words")
        member = spill(member)
        said = texts.select("conv", "depth", "role", "text")
        other = member.where("conv <> owner").select("conv", "depth", "owner", "before", "m").join(said, ["conv", "depth"])
        first = member.where("conv = owner and n > 1").select("conv", "depth", F.col("before").alias("o_before")).join(said, ["conv", "depth"])
        first = first.select(F.col("conv").alias("owner"), "depth", "o_before", F.col("role").alias("o_role"), F.col("text").alias("o_text"))
        differ = spill(other.join(first, ["owner", "depth"]).where("before <> o_before or role <> o_role or text <> o_text").select("conv", "depth", F.lit(1).cast("long").alias("more")))
        drop_spill(marked)
        if not differ.limit(1).count():
            return member.drop("h", "m", "before")
        old, light = light, spill(light.join(differ, ["conv", "depth"], "left").withColumn("mark", F.col("mark") + F.coalesce("more", F.lit(0))).drop("more"))
        drop_spill(old, member)


def _joined_ids(batches):
    """Of rows sorted by owner, depth, conv: up to CHUNK decimal ids of a node in a row, with the first."""
    for batch in batches:
        if not len(batch):
            continue
        owner, depth, conv = (np.asarray(batch.column(i)) for i in range(3))
        new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (depth[1:] != depth[:-1])))
        new[::CHUNK] = True
        at = np.flatnonzero(new)
        ids = [",".join(map(str, x.tolist())) for x in np.split(conv, at[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(owner[at]), pa.array(depth[at]), pa.array(conv[at]), pa.array(ids)], names=["owner", "depth", "first", "ids"])


def _digest_of(batches):
    """Of rows sorted by owner, depth, first: the SHA-256 of each node's ids, joined by commas."""
    key, digest = None, None
    for batch in batches:
        done = []
        for owner, depth, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
            if (owner, depth) == key:
                digest.update(b"," + ids.encode())
                continue
            if key is not None:
                done.append((*key, digest.hexdigest()))
            key, digest = (owner, depth), hashlib.sha256(ids.encode())
        if done:
            yield _digests(done)
    if key is not None:
        yield _digests([(*key, digest.hexdigest())])


def _digests(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["owner", "depth", "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """owner, depth, ends_sha256 of rows owner, depth, conv: SHA-256 of a node's conv ids in numeric order.

    Ids are joined in parts by range; a task then reads a node's parts in order, CHUNK ids each, and holds one.
    """
    parts = ends.repartitionByRange("owner", "depth", "conv").sortWithinPartitions("owner", "depth", "conv").mapInArrow(tidy(_joined_ids), "owner long, depth long, first long, ids string")
    parts = parts.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "first")
    return parts.mapInArrow(tidy(_digest_of), "owner long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame | None = None, bits: int = 64) -> DataFrame:
    """The trie of conversations by their turns: a row for each distinct sequence of first turns, and the root.

    turns: conv_id, turn, role, text, in order of turn (null first; ties by role, then text, so repeated rows
    are turns of their own); null role and text are empty. convs: conv_id of conversations that may have no
    turns. Null conv_ids are dropped; no conversations give no rows; other columns are ignored.

    conv_id (smallest member), depth, parent_conv_id (null for the root), role, text (of the last turn; null for
    the root), n_convs (members: conversations that begin with the sequence), n_children, n_leaves (childless
    nodes at or below), saved_tokens (at or below, words of the last text for every member but one), ends_sha256
    (of the ids of the members that end here, in numeric order).

    Fingerprints of prefixes group candidates, which are verified against the owner, the smallest member
    (`_members`). Each conversation owns a stretch of its own path, the nodes of which no smaller conversation
    is a member; so what lies at or below a node is the sum, over its members, of what each owns from that
    depth on, and one aggregation rolls all depths up, however deep.
    """
    texts = spill(_ordered(turns))
    every = texts.select("conv").distinct()
    if convs is not None:
        every = every.unionAll(convs.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"))).distinct()
    every = spill(every)
    member = _members(texts, bits)
    mine = F.col("owner") == F.col("conv")
    own = member.groupBy("conv").agg(
        F.min(F.when(mine, F.col("depth"))).alias("k"),
        F.max(F.when(~mine, F.struct("depth", "owner")))["owner"].alias("hang"),
        F.max((mine & F.col("last") & F.col("leaf")).cast("long")).alias("leaves"),
    )
    own = spill(own)
    # saved from a depth on, in blocks of a conversation and over its blocks
    rows = member.withColumn("block", F.expr(f"depth div {BLOCK}")).withColumn("own_saved", F.when(mine, (F.col("n") - 1) * F.col("words")).otherwise(F.lit(0)))
    after = Window.partitionBy("conv").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv", "block").agg(F.sum("own_saved").alias("s")).select("conv", "block", F.coalesce(F.sum("s").over(after), F.lit(0)).alias("later"))
    on = Window.partitionBy("conv", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("within", F.sum("own_saved").over(on)).join(blocks, ["conv", "block"]).join(own, "conv")
    grown = F.when(F.col("last"), 0).when(F.col("k") <= F.col("depth") + 1, 1).otherwise(0)
    nodes = rows.groupBy("owner", "depth").agg(
        F.max(F.when(mine, F.when(F.col("k") < F.col("depth"), F.col("conv")).otherwise(F.col("hang")))).alias("above"),
        F.count("*").alias("n_convs"), F.sum(grown).cast("long").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum(F.col("within") + F.col("later")).alias("saved_tokens"),
    )
    root = every.agg(F.min("conv").alias("root"), F.count("*").alias("n_convs")).where("root is not null")
    saved = rows.where("depth = 1").agg(F.coalesce(F.sum(F.col("within") + F.col("later")), F.lit(0)).alias("saved_tokens"))
    below = own.agg(F.coalesce(F.sum((F.col("k") == 1).cast("long")), F.lit(0)).alias("n_children"), F.greatest(F.coalesce(F.sum("leaves"), F.lit(0)), F.lit(1)).alias("n_leaves"))
    top = spill(root.crossJoin(F.broadcast(below)).crossJoin(F.broadcast(saved)))  # one row each
    ends = member.where("last").select("owner", "depth", "conv")
    silent = every.join(own.select("conv"), "conv", "left_anti").crossJoin(F.broadcast(top.select("root")))  # one row
    ends = ends.unionAll(silent.select(F.col("root").alias("owner"), F.lit(0).cast("long").alias("depth"), "conv"))
    digests = ends_digests(spill(ends))
    said = texts.select(F.col("conv").alias("owner"), "depth", "role", "text")
    none = F.lit(None)
    out = nodes.join(said, ["owner", "depth"]).crossJoin(F.broadcast(top.select("root")))  # one row
    out = out.select("owner", "depth", F.coalesce("above", "root").alias("parent_conv_id"), "role", "text", "n_convs", "n_children", "n_leaves", "saved_tokens")
    out = out.unionAll(top.select(F.col("root").alias("owner"), F.lit(0).cast("long"), none.cast("long"), none.cast("string"), none.cast("string"), "n_convs", "n_children", "n_leaves", "saved_tokens"))
    out = out.join(digests, ["owner", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
    return out.withColumnRenamed("owner", "conv_id")
