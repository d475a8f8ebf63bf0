"""The corpus pipeline: language ID, exact and near deduplication, secret redaction, packing, each over all that the stage before kept.

For every stage: null and empty texts, texts of any length, ties, repeated rows, an empty table and further columns, whatever
their names, are handled as the operator that it calls says; what each decides about a row is repeated below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import exact_dedup, langid, packing, secret_scan, simhash
from strandline.llm.common import delete, release, remainder, shared_path, written
from strandline.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those that the calibrated limit rejects, or without a letter, go. lang stays as it was.

    Null and empty texts have no letter, so they go; rows that repeat an id are decided by their own texts. Without any
    labelled text, as in an empty table, no language can be told, and nothing stays.
    """
    model = langid.fit(docs, remainder("doc_id", 5) != 0)
    return langid.keep_known(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) the document with the smallest id, once; null and empty texts are equal."""
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group of near-duplicates the document with the smallest id; rows that repeat that id stay with it.

    Texts are near-duplicates if their fingerprints of five-word shingles differ in at most 8 of 64 bits, and second
    fingerprints by another seed in at most 12. Texts without words have equal fingerprints.
    """
    return simhash.near_dedup(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced and n_chars made to fit; null texts stay null."""
    return secret_scan.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; a null or empty text is its end id."""
    out = packing.pack(docs, tokenizer_path())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_id")


STAGES = [("language ID", language), ("exact dedup", exact), ("near dedup", near), ("secret scan", secrets), ("packing", pack)]

#: No stage but exact dedup can be said in SQL; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each one's result written to the shared folder and read again.

    What a stage wrote for itself, and the stage before, goes once its result is written; the last result stays until
    release() or the driver's end, as the returned table reads it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = shared_path(spark, "pipeline")
    since = written(spark)
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
        release(spark, since)
        if i:
            delete(spark, [f"{base}/{i - 1}"])
    return docs
