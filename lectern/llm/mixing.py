"""Mixing sources to target weights by Pfair scheduling: earliest deadline first over blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import drop_spill, spill

#: Documents of a block, slots of a round of the schedule, and rows that one task numbers.
BLOCK_DOCS, SLOTS, NUMBERED = 16, 1 << 18, 2_000
#: The greatest weight as a whole number; the others are in proportion, at least 1.
UNIT = 1 << 30
#: Slots that one step of the fold adds to the schedule.
STEP = 512


def whole_weights(weights: DataFrame) -> DataFrame:
    """source, w: weights as whole numbers, the greatest UNIT; columns source, weight.

    A source's largest weight counts. Null, negative, zero and non-finite weights count as the least
    positive one given, or 1. Rounding moves a source by less than a thousandth of a block in 2^18 slots.
    """
    w = weights.groupBy("source").agg(F.max(F.when((F.col("weight") > 0) & (F.col("weight") < float("inf")), F.col("weight").cast("double"))).alias("weight"))
    ends = w.agg(F.min("weight").alias("least"), F.max("weight").alias("most"))
    w = w.crossJoin(F.broadcast(ends))  # one row
    return w.select("source", F.greatest(F.lit(1), F.round(F.coalesce("weight", "least", F.lit(1.0)) / F.coalesce("most", F.lit(1.0)) * UNIT).cast("long")).cast("long").alias("w"))


def schedule(blocks: DataFrame) -> DataFrame:
    """source, block, slot of blocks by earliest deadline first; columns source, w (whole weight), blocks.

    With W the sum of the weights, block b of a source of weight w may run from slot floor(b W / w) and
    must run before ceil((b + 1) W / w): its Pfair window. In each slot the released block of the
    earliest deadline runs; ties go to the source that comes first. As the shares w / W sum to 1 no
    deadline is missed, so in any prefix a source's blocks differ from its share of the prefix by less
    than one. A source that has ended keeps its slots, empty.

    Slots follow one another until all sources but one have ended, however many they are, in a fold over
    one row with a number for each source: SLOTS slots a round, whose last numbers are written and begin the
    next one; STEP slots at a time, whose picks are kept in an array of arrays. Nothing of the documents is in
    the fold. Blocks without a slot belong to the last source; they are left to run in the last slot before
    their deadlines (`mix`).
    """
    s = blocks.agg(F.array_sort(F.collect_list(F.struct("source", "w", "blocks"))).alias("s"), F.sum("w").alias("total"))
    # when each source has run all its blocks
    ends = F.expr("reverse(array_sort(transform(s, x -> (cast(x.blocks as decimal(20)) * total + x.w - 1) div x.w)))")
    s = s.withColumn("slots", F.coalesce(F.get(ends, F.lit(1)), F.get(ends, F.lit(0)), F.lit(0)).cast("long"))
    now = spill(s.select("s", "total", "slots", F.expr("transform(s, x -> 0L)").alias("run"), F.expr("transform(s, x -> (total + x.w - 1) div x.w)").alias("late"), F.expr("transform(s, x -> 0L)").alias("free")))
    slots, rounds = now.first()["slots"], []
    for at in range(0, slots, SLOTS):
        rounds.append(spill(now.select("s", "total", "run", F.lit(at).cast("long").alias("at"), F.expr(_fold(at, min(slots, at + SLOTS))).alias("acc"))))
        now = rounds[-1].select("s", "total", "acc.run", "acc.late", "acc.free")
    if not rounds:
        return blocks.select("source", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("slot")).where("false")
    every = blocks.sparkSession.read.schema(rounds[0].schema).parquet(*[f for r in rounds for f in r.inputFiles()])
    picked = every.select("s", "run", "at", F.posexplode("acc.out").alias("k", "picks")).select("s", "run", "at", "k", F.posexplode("picks").alias("i", "p")).where("p is not null")
    picked = picked.select("at", F.expr("s[p].source").alias("source"), F.expr("s[p].blocks").alias("blocks"), F.expr("run[p]").alias("before"), (F.col("at") + F.col("k").cast("long") * STEP + F.col("i")).alias("slot"))
    number = F.row_number().over(Window.partitionBy("at", "source").orderBy("slot")) - 1
    return picked.withColumn("block", F.col("before") + number).where("block < blocks").select("source", "block", "slot")


def _fold(first: int, stop: int) -> str:
    """The slots from first up to stop, of columns s, total, run, late, free: the last of these three afterwards, and in `out` the places of the sources that run."""
    return f"""
      aggregate(sequence(0L, {(stop - first - 1) // STEP}L),
        named_struct('run', run, 'late', late, 'free', free, 'out', cast(array() as array<array<int>>)),
        (acc, k) -> element_at(transform(array(
          aggregate(sequence({first}L + k * {STEP}, least({stop}L, {first}L + (k + 1) * {STEP}) - 1),
            named_struct('run', acc.run, 'late', acc.late, 'free', acc.free, 'out', cast(array() as array<int>)),
            (a, t) -> element_at(transform(
              array(array_min(transform(a.late, (d, i) -> if(a.free[i] <= t, named_struct('d', d, 'i', i), null))).i),
              p -> named_struct(
                'run', transform(a.run, (r, i) -> if(i = p, r + 1, r)),
                'late', transform(a.late, (d, i) -> if(i = p, ((a.run[i] + 2) * total + s[i].w - 1) div s[i].w, d)),
                'free', transform(a.free, (r, i) -> if(i = p, (a.run[i] + 1) * total div s[i].w, r)),
                'out', array_append(a.out, p))), 1))),
          y -> named_struct('run', y.run, 'late', y.late, 'free', y.free, 'out', array_append(acc.out, y.out))), 1))"""


def mix(docs: DataFrame, weights: DataFrame, doc_id: str = "doc_id", source: str = "source", keep: list[str] | None = None) -> DataFrame:
    """doc_id, source, block, slot, place: where each document stands in the mix; order by slot, place.
    With `keep`, those columns of docs and __slot, __place instead.

    Documents of a source are numbered in hash order and cut in blocks of BLOCK_DOCS, however many there
    are; each block stands at its slot of `schedule`, so in any
    prefix of the schedule a source's blocks differ from its target weight by less than one block.
    Every document is kept once: when a source ends its slots stay empty, and the others keep their
    order and proportions.

    weights: source, weight; sources without one get the least weight given. A null source is a source.
    Null doc_ids come first within their source; repeated rows each get a place. A source however
    large is numbered in buckets of about NUMBERED rows, from their counts' running sums. The schedule,
    a row for each block, and tables of a row for each source are broadcast only if Spark finds them small.
    """
    own = {c: F.col(f"`{c}`") for c in keep or []}
    d = docs.select(F.col(doc_id).alias("__id"), F.col(source).alias("__source"), *own.values())
    # the small tables are spilled so that their sizes are known when the joins with all rows are planned
    count = spill(d.groupBy("__source").agg(F.count("*").alias("n")))
    given = weights.select(F.col("source").alias("ws"), F.col("weight").alias("weight"))
    whole = whole_weights(count.join(given, F.expr("__source <=> ws"), "left").select(F.col("__source").alias("source"), "weight"))
    known = count.join(whole, F.expr("__source <=> source")).select("source", "w", "n", F.ceil(F.col("n") / BLOCK_DOCS).cast("long").alias("blocks"))
    known = known.crossJoin(F.broadcast(whole.agg(F.sum("w").alias("total"))))  # one row
    known = spill(known)
    plan = spill(schedule(known.select("source", "w", "blocks")))
    d = d.withColumn("__h", F.md5(F.col("__id").cast("string").cast("binary")))
    high = F.coalesce(F.conv(F.substring("__h", 1, 8), 16, 10).cast("long"), F.lit(0))
    of = known.select(F.col("source").alias("__bs"), F.ceil(F.col("n") / NUMBERED).cast("long").alias("__m"), F.col("w").alias("__w"), F.col("total").alias("__total"))
    d = d.join(of, F.expr("__source <=> __bs")).withColumn("__bucket", F.shiftright(high * F.col("__m"), 32)).drop("__bs", "__m")
    per = d.groupBy("__source", "__bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = spill(per.select(F.col("__source").alias("__ps"), F.col("__bucket").alias("__pb"), before.alias("__before")))
    within = F.row_number().over(Window.partitionBy("__source", "__bucket").orderBy("__h", "__id"))
    d = d.withColumn("__within", within).join(per, F.expr("__source <=> __ps and __bucket = __pb"))
    d = d.withColumn("__number", F.col("__before") + F.col("__within") - 1).withColumn("__block", F.expr(f"__number div {BLOCK_DOCS}"))
    plan = plan.select(F.col("source").alias("__ss"), F.col("block").alias("__j"), F.col("slot").alias("__at"))
    d = d.join(plan, F.expr("__source <=> __ss and __block = __j"), "left")
    slot = F.coalesce("__at", F.expr("((cast(__block as decimal(20)) + 1) * __total + __w - 1) div __w - 1"))
    place = F.expr(f"cast(__number % {BLOCK_DOCS} as int)")
    drop_spill(count)
    if keep is not None:
        return d.select(*own.values(), slot.alias("__slot"), place.alias("__place"))
    return d.select(F.col("__id").alias("doc_id"), F.col("__source").alias("source"), F.col("__block").alias("block"), slot.alias("slot"), place.alias("place"))


def target_weights(docs: DataFrame, power: float = 0.5) -> DataFrame:
    """source, weight: documents of the source to the power; below 1 it lifts small sources."""
    return docs.groupBy("source").agg(F.pow(F.count("*").cast("double"), F.lit(power)).alias("weight"))
