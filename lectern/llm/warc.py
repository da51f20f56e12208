"""WARC records: reading and writing, and resolving not-modified revisits by an as-of join."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of one URL that one task orders.
ORDERED = 10_000
#: Parts that a URL with more rows is cut in.
PARTS = 256

# fixed values: header fields that a 304 response may update in the stored one (RFC 9111, section 3.2
# leaves out those that describe the stored body)
BODY_HEADERS = ("content-encoding", "content-length", "content-range", "content-type", "transfer-encoding")
# fixed values: query parameters that only track where a visitor came from
TRACKING = ("fbclid", "gclid", "ref", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term")

RECORD = "path string, warc_type string, record_id string, url string, date string, status int, headers map<string,string>, body binary"


def canonical_url(url: F.Column) -> F.Column:
    """Host and path in a form that equal pages share; null for null.

    No scheme, user, www., default port, fragment, tracking parameters or slash at the end; the host in
    lower case; the other parameters in order. An empty string stays empty.
    """
    u = F.regexp_replace(url, r"#.*$", "")
    u = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    site = F.lower(F.regexp_extract(u, r"^([^/?]*)", 1))
    site = F.regexp_replace(F.regexp_replace(site, r"^[^@]*@", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(u, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    params = F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&")
    params = F.array_join(F.array_sort(F.filter(params, lambda p: (p != "") & ~F.regexp_extract(p, r"^([^=]*)", 1).isin(*TRACKING))), "&")
    return F.concat(F.regexp_replace(site, r"^www\.", ""), path, F.when(params != "", F.concat(F.lit("?"), params)).otherwise(""))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Each revisit with the latest earlier full response of its canonical URL.

    records: id long, url string, ts (any ordered type that casts to long or double), kind ('response'
    or 'revisit'), etag, last_modified, digest strings, headers map<string,string> with lower-case
    names. Returns for each revisit: id, url (canonical), ts, response_id, response_ts, digest,
    headers, outcome:
    - 'resolved': its etag, or without one its last_modified, equals the response's (etags without W/);
    - 'unchecked': it carries neither, or the response lacks the one that it carries;
    - 'mismatch': they differ; - 'missing': there is no earlier response.
    For resolved and unchecked ones digest and headers are the response's, headers with the revisit's
    in their place except those that describe a body (null ones count as empty); else they are null.

    Earlier means a smaller ts; of several at one ts the greatest id. Rows with a null url, ts or kind
    neither resolve nor serve: such revisits are 'missing'. Repeated rows resolve each. Other columns
    are dropped. Responses of one URL and ts are one to a revisit, so they fold into their last, and revisits
    of one URL and ts ask once. What is left of a URL with more than ORDERED different ts is cut at
    quantiles of ts into PARTS parts, each of which starts from the last response of those before.
    """
    r = records.select("id", canonical_url(F.col("url")).alias("url"), "ts", "kind", "etag", "last_modified", "digest", "headers", F.col("ts").cast("double").alias("t"))
    odd = F.col("url").isNull() | F.col("t").isNull()
    lost = r.where(odd & (F.col("kind") == "revisit"))
    r = r.where(~odd & F.col("kind").isin("response", "revisit"))
    own = F.struct("t", "id", "ts", "etag", "last_modified", "digest", "headers")
    served = r.where("kind = 'response'").groupBy("url", "t").agg(F.max_by(own, F.col("id")).alias("own"))
    asked = r.where("kind = 'revisit'").select("url", "t").distinct()
    # at one ts the question stands before the answer, so what precedes it is earlier
    e = served.select("url", "t", F.lit(1).alias("side"), "own").unionAll(asked.select("url", "t", F.lit(0).alias("side"), F.lit(None).cast(served.schema["own"].dataType).alias("own")))
    span = e.groupBy("url").agg(F.count("*").alias("n"), F.percentile_approx("t", [i / PARTS for i in range(1, PARTS)], 10 * PARTS).alias("cuts"))
    span = span.where(F.col("n") > ORDERED).select(F.col("url").alias("su"), F.array_distinct("cuts").alias("cuts"))
    part = F.coalesce(F.size(F.filter("cuts", lambda x: x <= F.col("t"))), F.lit(0))
    e = e.join(span, F.col("url") == F.col("su"), "left").withColumn("part", F.when(F.col("su").isNull(), 0).otherwise(part)).drop("su", "cuts")
    last = e.where("own is not null").groupBy("url", "part").agg(F.max_by("own", F.col("t")).alias("last"))
    many = e.where("part > 0").select("url", "part").distinct()
    many = many.unionAll(many.select("url", F.lit(0)).distinct()).distinct().join(last, ["url", "part"], "left")
    carry = F.last("last", ignorenulls=True).over(Window.partitionBy("url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    many = many.select(F.col("url").alias("cu"), F.col("part").alias("cp"), carry.alias("carry")).where("carry is not null")
    order = Window.partitionBy("url", "part").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("before", F.last("own", ignorenulls=True).over(order)).where("side = 0")
    e = e.join(many, F.expr("url = cu and part = cp"), "left").select(F.col("url").alias("eu"), F.col("t").alias("et"), F.coalesce("before", "carry").alias("r"))
    v = r.where("kind = 'revisit'").drop("kind").join(e, F.expr("url = eu and t = et")).drop("eu", "et")
    plain = lambda c: F.regexp_replace(c, "^W/", "")
    check = F.when(F.col("etag").isNotNull(), plain(F.col("r.etag")) == plain(F.col("etag"))).when(F.col("last_modified").isNotNull(), F.col("r.last_modified") == F.col("last_modified"))
    outcome = F.when(F.col("r").isNull(), "missing").when(check, "resolved").when(check.isNull(), "unchecked").otherwise("mismatch")
    none = F.create_map().cast("map<string,string>")
    merged = F.map_concat(
        F.map_filter(F.coalesce("r.headers", none), lambda k, _: k.isin(*BODY_HEADERS) | ~F.coalesce(F.array_contains(F.map_keys("headers"), k), F.lit(False))),
        F.map_filter(F.coalesce("headers", none), lambda k, _: ~k.isin(*BODY_HEADERS)),
    )
    v = v.withColumn("outcome", outcome)
    fine = F.col("outcome").isin("resolved", "unchecked")
    out = v.select("id", "url", "ts", F.col("r.id").alias("response_id"), F.col("r.ts").alias("response_ts"), F.when(fine, F.col("r.digest")).alias("digest"), F.when(fine, merged).alias("headers"), "outcome")
    alone = lost.select("id", "url", "ts", F.lit(None).cast("long").alias("response_id"), F.lit(None).cast(r.schema["ts"].dataType).alias("response_ts"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("map<string,string>").alias("headers"), F.lit("missing").alias("outcome"))
    return out.unionAll(alone)


def _head(lines: list[bytes]) -> dict[str, str]:
    pairs = (line.decode("utf-8", "replace").partition(":") for line in lines)
    return {k.strip().lower(): v.strip() for k, sep, v in pairs if sep}


def parse_warc(data: bytes):
    """Records of a WARC file, plain or with gzip members: tuples in the order of RECORD without path.

    For HTTP responses, status and headers are the response's and body what follows them; else status
    is null, headers are the record's own and body its block. What follows a broken record is left.
    """
    if data[:2] == b"\x1f\x8b":
        parts, rest = [], data
        while rest[:2] == b"\x1f\x8b":
            z = zlib.decompressobj(31)
            parts.append(z.decompress(rest) + z.flush())
            rest = z.unused_data
        data = b"".join(parts)
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        own = _head(data[at:end].split(b"\r\n")[1:])
        size = own.get("content-length", "")
        if not size.isdigit() or end + 4 + int(size) > len(data):
            return
        block = data[end + 4 : end + 4 + int(size)]
        at = end + 4 + int(size)
        status, headers, body = None, own, block
        if block[:5] == b"HTTP/":
            head, _, body = block.partition(b"\r\n\r\n")
            lines = head.split(b"\r\n")
            code = lines[0].split(b" ")
            status = int(code[1]) if len(code) > 1 and code[1].isdigit() else None
            headers = _head(lines[1:])
        yield own.get("warc-type"), own.get("warc-record-id"), own.get("warc-target-uri"), own.get("warc-date"), status, headers, body


def format_warc(kind: str, record_id: str, url: str, date: str, block: bytes) -> bytes:
    """One plain record; kind is warcinfo, response, revisit and so on."""
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {record_id}\r\nWARC-Target-URI: {url}\r\nWARC-Date: {date}\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files under path, as RECORD. A file is read by one task and must fit it."""

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = [(name, *r) for r in parse_warc(data)]
                kinds = [pa.string()] * 5 + [pa.int32(), pa.map_(pa.string(), pa.string()), pa.binary()]
                names = ["path", "warc_type", "record_id", "url", "date", "status", "headers", "body"]
                cols = list(zip(*rows, strict=True)) or [[]] * 8
                cols[6] = [list(h.items()) for h in cols[6]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RECORD)
