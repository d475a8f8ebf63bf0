"""The driver's tables as the shapes that operators take, and the SQL that makes the same shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

CODES = "ACGTRYKMSWBDHVN-"
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ-"


def dna(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    """Texts' letters A, C, G and T as sequences."""
    seq = F.regexp_replace(F.upper(F.coalesce("text", F.lit(""))), "[^ACGT]", "")
    return table(spark, sf_dir, name).select(F.col(key).alias("name"), F.col(key).cast("int").alias("ord"), seq.alias("seq"))


DNA_SQL = "seqs AS (SELECT doc_id AS name, regexp_replace(upper(coalesce(text, '')), '[^ACGT]', '', 'g') AS seq FROM documents)"
BENCH_SQL = "seqs AS (SELECT item_id AS name, regexp_replace(upper(coalesce(text, '')), '[^ACGT]', '', 'g') AS seq FROM benchmark)"


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as sequences with ambiguity codes, spaces as gaps."""
    seq = F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), LOWER, UPPER), f"[^{CODES}]", "")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), F.col("doc_id").cast("int").alias("ord"), seq.alias("seq"))


CODES_SQL = f"seqs AS (SELECT doc_id AS name, regexp_replace(translate(coalesce(text, ''), '{LOWER}', '{UPPER}'), '[^{CODES}]', '', 'g') AS seq FROM documents)"


def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as aligned sequences: each component becomes a letter or a gap by fixed thresholds."""
    def letter(x: Column) -> Column:
        v = x.cast("double")
        return F.when(v < -0.1, "A").when(v < 0, "C").when(v < 0.1, "G").when(v < 0.22, "T").otherwise("-")

    seq = F.array_join(F.transform("embedding", letter), "")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("name"), F.col("vec_id").cast("int").alias("ord"), seq.alias("seq"))


_LETTER = "CASE WHEN x::DOUBLE < -0.1 THEN 'A' WHEN x::DOUBLE < 0 THEN 'C' WHEN x::DOUBLE < 0.1 THEN 'G' WHEN x::DOUBLE < 0.22 THEN 'T' ELSE '-' END"
ALN_SQL = f"aln AS (SELECT vec_id AS name, array_to_string(list_transform(embedding, lambda x: {_LETTER}), '') AS seq FROM embeddings)"
LONG_SQL = ALN_SQL + ", long AS (SELECT name, pos, seq[pos + 1] AS ch FROM (SELECT name, seq, unnest(range(length(seq))) AS pos FROM aln))"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as rows of amounts: absolute values, small ones as 0."""
    v = F.transform("embedding", lambda x: F.when(F.abs(x.cast("double")) < 0.05, 0.0).otherwise(F.abs(x.cast("double"))))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("name"), v.alias("v"))


VEC_SQL = "vecs AS (SELECT vec_id AS name, list_transform(embedding, lambda x: CASE WHEN abs(x::DOUBLE) < 0.05 THEN 0.0::DOUBLE ELSE abs(x::DOUBLE) END) AS v FROM embeddings)"
PAIR_SQL = VEC_SQL + ", pairs AS (SELECT p.name AS name1, q.name AS name2, p.v AS a, q.v AS b FROM vecs p JOIN vecs q ON p.name < q.name)"


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as features: a user is a sequence, a type a biotype, a second a place."""
    start = F.unix_timestamp("ts")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("seqid"),
        F.col("event_type").alias("biotype"),
        F.col("event_id").cast("string").alias("name"),
        start.alias("start"),
        (start + F.ceil(F.abs("value")).cast("long") * 60 + 60).alias("stop"),
        F.col("value"),
    )


SPAN_SQL = """f AS (SELECT user_id::VARCHAR AS seqid, event_type AS biotype, event_id::VARCHAR AS name, floor(epoch(ts))::BIGINT AS start,
  floor(epoch(ts))::BIGINT + ceil(abs(value))::BIGINT * 60 + 60 AS stop, value FROM events)"""
