"""Readers and writers: JSONL with checks, CSV, XML, file manifests, uploads, fan-out sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import html_to_text, word_count

MESSAGES = "messages array<struct<role:string,content:string>>"
TOPIC = "_id string, _title string, _url string, _language string, `full-summary` string"


def read_records(spark: SparkSession, path: str, slug: str) -> tuple[DataFrame, DataFrame]:
    """(records, errors) of JSONL files of SFT messages.

    records: record_id (slug, first 12 digits of the user text's SHA-256), dataset_slug, source_path,
    source_text, source_sha256. errors: source_path and line of what isn't JSON or lacks a user text.
    Blank lines are skipped. Line numbers need an order that distributed reads don't keep; the file and
    the line itself identify an error.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("line")).where(F.trim("line") != "")
    parsed = raw.withColumn("r", F.from_json("line", MESSAGES))
    user = F.get(F.filter("r.messages", lambda m: m["role"] == "user"), F.lit(0))["content"]
    parsed = parsed.withColumn("source_text", user)
    bad = F.col("r").isNull() | (F.trim(F.coalesce("source_text", F.lit(""))) == "")
    good = parsed.where(~bad).withColumn("source_sha256", F.sha2("source_text", 256))
    record = F.concat_ws(":", F.lit(slug), F.left("source_sha256", F.lit(12)))
    return good.select(record.alias("record_id"), F.lit(slug).alias("dataset_slug"), "source_path", "source_text", "source_sha256"), parsed.where(bad).select("source_path", "line")


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSONL that fails on the first line that isn't an object of the schema."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSONL, or no rows of the schema if the path doesn't exist."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """id, n of a list with # comments; n over 1 is a duplicate."""
    t = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*", "")).alias("id")).where("id <> ''")
    return t.groupBy("id").agg(F.count("*").alias("n"))


def read_topics(spark: SparkSession, path: str, least_words: int = 250) -> DataFrame:
    """English health topics of XML files with a summary of enough words, as plain text."""
    x = spark.read.format("xml").option("rowTag", "health-topic").schema(TOPIC).load(path).where("_language = 'English'")
    x = x.select(F.col("_id").alias("id"), F.col("_title").alias("title"), F.col("_url").alias("url"), html_to_text(F.col("full-summary")).alias("text"))
    return x.withColumn("words", word_count(F.col("text"))).where(F.col("words") >= least_words)


def read_table(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """CSV with a header, all columns strings; an empty field is null."""
    return spark.read.option("header", True).options(**options).csv(path)


def first_filled(*columns: str) -> F.Column:
    """The first of the columns that isn't null or blank."""
    return F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, modified, sha256 and lines of files. A file must fit a task."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    lines = F.length("content") - F.length(F.replace(F.col("content").cast("string"), F.lit("\n"), F.lit("")).cast("binary"))
    return b.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), lines.cast("long").alias("lines"))


def decode_uploads(df: DataFrame, name: str, content: str, most: int = 50_000) -> DataFrame:
    """df with text and notice from base64 content of .txt names: cut at `most` characters; other kinds null."""
    text = F.decode(F.unbase64(content), "UTF-8")
    plain = F.lower(F.col(name)).endswith(".txt")
    notice = F.when(~plain, "unsupported").when(F.length(text) > most, "truncated")
    return df.withColumns({"text": F.when(plain, F.left(text, F.lit(most))), "notice": notice})


def write_fan_out(df: DataFrame, path: str, *by: str) -> None:
    """JSONL in a folder for each value of the columns; Spark's commit makes it appear whole."""
    df.write.mode("overwrite").partitionBy(*by).json(path)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, copies counted."""
    return not (a.exceptAll(b).limit(1).count() or b.exceptAll(a).limit(1).count())
