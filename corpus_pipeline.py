"""The corpus pipeline: documents become training windows in five stages, each written as Parquet and read again.

Every stage works on all rows of the one before, and all but the last return the columns of documents. What the operators do
with nulls, empty and very long texts, ties, repeated rows, empty tables and further columns is said for each stage; tests
run all of them over such rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lectio.llm import decontam, minhash, packing, rules, secrets
from lectio.session import delete, mark, shared_dir, sweep


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail the rules go, and documents that lose too much by it: null, empty and blank texts among them, as they have
    nothing to keep. Null ids, repeated rows and further columns stay as they are; an empty table gives no rows."""
    return rules.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each connected group of near duplicates the document with the smallest id stays. Rows without an id or a word stay; of
    rows that repeat an id the one with the smallest text does. Further columns stay; an empty table gives no rows."""
    return minhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a long run of words with a benchmark text go. Null and empty texts stay, null ids and repeated rows
    are judged like others, further columns stay; an empty table, or an empty benchmark, takes nothing away."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every row and column stays, nulls, empty texts and repeated rows included; an empty table gives no rows."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of token ids over all documents left, with the doc_ids of their pieces. Null and empty texts have no tokens, rows
    without an id come first, repeated rows are each packed, further columns are ignored; an empty table gives no rows."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("near_dedup", near_duplicates), ("decontamination", decontamination), ("secret_scan", secret_scan), ("packing", pack)]

#: Signatures, suffix arrays, entropies and the packing can't be expressed in SQL; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the documents in sf_dir.

    They lie in the shared folder, under a name of this run; what came before them is deleted as soon as the next stage is
    written. The windows hold their token ids, so nothing else is needed to train on them.
    """
    docs, base, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for i, (name, stage) in enumerate(STAGES):
        path, before = f"{base}/{i}-{name}", mark()
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        sweep(spark, before)
        if last:
            delete(spark, last)
        last = path
    return docs
