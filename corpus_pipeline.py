"""The corpus pipeline: quality, near-duplicates, repeated passages, mixing, encoding.

Each stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.bpe import encode_documents
from lectern.llm.common import spill
from lectern.llm.minhash import one_of_each_group
from lectern.llm.mixing import mix, target_weights
from lectern.llm.passages import cut_passages, repeated_passages
from lectern.llm.quality import accepted_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; the others go."""
    return accepted_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates, and those without an id.

    Of rows that repeat a kept id, one of each text stays.
    """
    return one_of_each_group(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document holds; n_chars follows the text."""
    return cut_passages(docs, repeated_passages(docs, forms=True)).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix: files by range of it, rows sorted in each file."""
    mixed = mix(docs, target_weights(docs), keep=docs.columns)
    return mixed.repartitionByRange("__slot", "__place").sortWithinPartitions("__slot", "__place").select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, digests of the ids and of the bytes they decode to, and the place in the mix: file_name and row_index, null if docs isn't a plain scan of files."""
    try:
        placed = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.row_index").alias("row_index"))
        placed.schema  # noqa: B018  resolves the names
    except AnalysisException:  # derived rows have no place in a file
        placed = docs.select("doc_id", "text", F.lit(None).cast("string").alias("file_name"), F.lit(None).cast("long").alias("row_index"))
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return encode_documents(placed, path, public_tokenizers.PATTERN, ["doc_id", "file_name", "row_index"], digests=True)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("mixing", mixing), ("encoding", encoding)]

#: SQL can't express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = spill(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
