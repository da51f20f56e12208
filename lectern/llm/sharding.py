"""Shards of shuffled records: a two-pass external shuffle, scattering by seeded hashes, then Fisher-Yates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import drop_spill, spill

#: Bytes and records of a bucket on average. A bucket's order is shuffled in one array, a swap of which
#: costs time in proportion to its records.
BUCKET_BYTES, BUCKET_ROWS = 16 << 20, 1_000
#: Bytes that a record counts for beside its text.
OVERHEAD = 16
#: Copies of a record that are numbered in one row, parts in which they are looked up, buckets whose
#: running count one task makes.
CHUNK, SALTS, SPAN = 1_000, 16, 1_000


def _draw(*parts: Column) -> Column:
    """A seeded number of 60 bits."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")), 1, 15), 16, 10).cast("long")


def _records(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """__row (all columns), __id, __size, __crc, __form: what tells records apart."""
    other = [F.col(f"`{c}`") for c in docs.columns if c not in (doc_id, text)]
    rest = [F.to_json(F.struct(*other))] if other else []
    t, i = F.col(f"`{text}`"), F.col(f"`{doc_id}`")
    size = (F.coalesce(F.octet_length(t), F.lit(0)) + OVERHEAD).cast("long")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("__row"), i.alias("__id"), size.alias("__size"), F.coalesce(F.crc32(t.cast("binary")), F.lit(0)).alias("__crc"), F.xxhash64(i, t, *rest).alias("__form"))


def _shuffled(records: str, seed: int) -> str:
    """SQL of the Fisher-Yates shuffle of an array column: from the last place down, each swaps with a drawn earlier one or itself."""
    draw = f"cast(conv(substring(md5(cast(concat_ws(':', '{seed}', 'swap', __bucket, i) as binary)), 1, 15), 16, 10) as bigint)"
    steps = f"transform(sequence(size({records}) - 1, 0, -1), i -> named_struct('i', i, 'j', cast({draw} % (i + 1) as int)))"
    return f"aggregate({steps}, {records}, (a, s) -> if(s.i = s.j, a, transform(a, (x, k) -> if(k = s.i, a[s.j], if(k = s.j, a[s.i], x)))))"


def places(rows: DataFrame, shards: int, seed: int) -> DataFrame:
    """__id, __form, __copy, __n, __bucket, __shard, __slot of the records that `_records` tells apart.

    Equal records are numbered and then scatter like others.
    """
    groups = spill(rows.groupBy("__id", "__size", "__crc", "__form").agg(F.count("*").alias("__n")))
    total = groups.agg(F.sum("__n").alias("__rows"), F.greatest(F.lit(1), F.ceil(F.sum(F.col("__size") * F.col("__n")) / BUCKET_BYTES), F.ceil(F.sum("__n") / BUCKET_ROWS)).cast("long").alias("__buckets"))
    total = spill(total)
    each = groups.withColumn("__chunk", F.explode(F.expr(f"sequence(0L, (__n - 1) div {CHUNK})"))).repartition("__form", "__chunk")
    each = each.withColumn("__copy", F.explode(F.expr(f"sequence(__chunk * {CHUNK}, least(__n, (__chunk + 1) * {CHUNK}) - 1)")))
    h = _draw(F.lit(seed), F.coalesce(F.col("__id").cast("string"), F.lit("")), F.col("__size"), F.col("__crc"), F.col("__copy"))
    each = each.withColumn("__h", h).crossJoin(F.broadcast(total.select("__buckets"))).withColumn("__bucket", F.expr("__h % __buckets"))  # one row
    record = F.struct("__h", "__id", "__size", "__crc", "__form", "__copy", "__n")
    bucket = spill(each.groupBy("__bucket").agg(F.array_sort(F.collect_list(record)).alias("__records")).select("__bucket", F.size("__records").cast("long").alias("__count"), F.expr(_shuffled("__records", seed)).alias("__records")))
    count = bucket.select("__bucket", "__count", F.expr(f"__bucket div {SPAN}").alias("__span"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    spans = count.groupBy("__span").agg(F.sum("__count").alias("__sum")).withColumn("__ahead", F.coalesce(F.sum("__sum").over(before.orderBy("__span")), F.lit(0)))
    count = count.join(spans, "__span").select("__bucket", (F.col("__ahead") + F.coalesce(F.sum("__count").over(before.partitionBy("__span").orderBy("__bucket")), F.lit(0))).alias("__before"))
    at = bucket.join(count, "__bucket").crossJoin(F.broadcast(total.select("__rows")))  # one row
    at = at.select("__bucket", "__before", "__rows", F.posexplode("__records").alias("__i", "r"))
    at = at.select("__bucket", "__rows", (F.col("__before") + F.col("__i")).alias("__at"), "r.*")
    shard = F.expr(f"cast(__at as decimal(30)) * {shards} div __rows")
    at = at.withColumn("__shard", shard.cast("int"))
    first = F.expr(f"(cast(__shard as decimal(30)) * __rows + {shards - 1}) div {shards}")
    placed = spill(at.withColumn("__slot", (F.col("__at") - first).cast("long")).select("__id", "__form", "__copy", "__n", "__bucket", "__at", "__shard", "__slot"))
    drop_spill(groups, total, bucket)
    return placed


def shuffle_shards(docs: DataFrame, shards: int = 40, seed: int = 7, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs in random order over shards 0 to shards - 1, with __shard and __slot (from 0 in each shard).

    A two-pass external shuffle. Records scatter by a seeded hash of their id, size, CRC-32 and, for equal
    records, number into buckets that fit in memory (BUCKET_BYTES, BUCKET_ROWS on average); each bucket is
    Fisher-Yates shuffled with draws that the seed, the bucket and the step give. Buckets follow one
    another, and shard s holds places ceil(s N / shards) to ceil((s + 1) N / shards) - 1 of that order of N
    records, so counts differ by one at most (law `rows`). The same rows and seed give the same shards
    however they are stored or computed. The order is made of ids and digests; the rows themselves are
    joined to it and dealt out by bucket, in the order of their slots within each partition.

    Null texts count as empty, null ids as an id, repeated rows each have a place; equal texts aren't held
    together. Fewer rows than shards leave shards empty; no rows give no rows. Rows that differ in columns
    other than id and text are told apart by a hash of their JSON.
    """
    rows = _records(docs, doc_id, text)
    placed = places(rows, shards, seed)
    out = ["__row", "__bucket", "__at", "__shard", "__slot"]

    def of(at: DataFrame, also: list[str]) -> DataFrame:
        return at.withColumnsRenamed({"__id": "__pid", "__form": "__pform", "__salt": "__psalt"}).select("__pid", "__pform", *also, *out[1:])

    once = rows.join(of(placed.where("__n = 1"), []), F.expr("__form = __pform and __id <=> __pid")).select(*out)
    if placed.where("__n > 1").limit(1).count():
        # of equal rows one is kept, and met by the places of all of them in SALTS parts
        many = placed.where("__n > 1").withColumn("__salt", F.col("__copy") % SALTS)
        known = many.where("__copy = 0").select(F.col("__id").alias("__kid"), F.col("__form").alias("__kform"))
        one = rows.join(known, F.expr("__form = __kform and __id <=> __kid"), "left_semi").dropDuplicates(["__id", "__form"])
        one = one.withColumn("__salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
        once = once.unionAll(one.join(of(many, ["__psalt"]), F.expr("__form = __pform and __salt = __psalt and __id <=> __pid")).select(*out))
    return once.repartition("__bucket").sortWithinPartitions("__bucket", "__at").select("__row.*", "__shard", "__slot")


def write_shards(docs: DataFrame, path: str, shards: int = 40, seed: int = 7) -> None:
    """Write docs as `shuffle_shards` deals them: a folder shard=s for each, whose rows carry their slot."""
    out = shuffle_shards(docs, shards, seed)
    out.withColumnsRenamed({"__shard": "shard", "__slot": "slot"}).write.partitionBy("shard").parquet(path)
