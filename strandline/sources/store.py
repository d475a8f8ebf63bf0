"""Data stores: members (id, content, md5), results with status, and logs, as Parquet folders or archives read by Spark."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

STATUS = ("completed", "not_completed", "log")


def open_store(spark: SparkSession, path: str, suffix: str = "*", limit: int | None = None) -> DataFrame:
    """(id, content, md5) of the files below a folder, or of the members of zip archives."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if path.endswith(".zip"):
        ship(spark)

        def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for data in f["content"]:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        for n in z.namelist():
                            if not n.endswith("/"):
                                yield pd.DataFrame([(n, z.read(n))], columns=["id", "content"])

        out = files.load(path).select("content").mapInPandas(unpack, "id string, content binary")
        out = out if suffix == "*" else out.filter(F.col("id").endswith("." + suffix.lstrip("*.")))
    else:
        glob = files.option("pathGlobFilter", suffix if "*" in suffix else "*." + suffix)
        out = glob.load(path).select(F.element_at(F.split("path", "/"), -1).alias("id"), "content")
    out = out.withColumn("md5", F.md5("content"))
    return out.orderBy("id").limit(limit) if limit is not None else out


def write_results(df: DataFrame, path: str, mode: str = "append") -> None:
    """Rows with `error` and any data, by status; the content's md5 goes with them."""
    data = [c for c in df.columns if c not in ("id", "error", "status", "md5")]
    payload = F.to_json(F.struct(*data))
    rows = df.select("id", F.when(F.col("error").isNull(), "completed").otherwise("not_completed").alias("status"), payload.alias("payload"), F.md5(payload).alias("md5"), F.col("error").alias("error"))
    rows.write.mode(mode).partitionBy("status").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def describe(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("number"))


def validate(results: DataFrame, content: str = "payload") -> DataFrame:
    """(correct, incorrect, missing): checksums compared."""
    ok = F.md5(content) == F.col("md5")
    return results.agg(F.count_if(ok).alias("correct"), F.count_if(~ok).alias("incorrect"), F.count_if(F.col("md5").isNull()).alias("missing"))


def summary_logs(lines: DataFrame) -> DataFrame:
    """(file, field, value) of log lines `time host:pid LEVEL key : value` (columns file, value)."""
    parts = F.split("value", "\t")
    text = F.element_at(parts, -1)
    return lines.filter(F.contains(text, F.lit(" : "))).select("file", F.trim(F.split(text, " : ", 2)[0]).alias("field"), F.trim(F.split(text, " : ", 2)[1]).alias("value"))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value")


# stores that are written in several runs
def write_attempt(df: DataFrame, path: str) -> None:
    """Appends results, each with the number of its id's attempt: one more than before."""
    spark = df.sparkSession
    try:
        before = spark.read.parquet(path).groupBy("id").agg(F.max("attempt").alias("__a"))
    except AnalysisException:  # nothing is there yet
        before = None
    data = [c for c in df.columns if c not in ("id", "error")]
    rows = df.select("id", F.when(F.col("error").isNull(), "completed").otherwise("not_completed").alias("status"), F.to_json(F.struct(*data)).alias("payload"), "error")
    rows = rows.withColumn("md5", F.md5("payload"))
    if before is None:
        rows = rows.withColumn("attempt", F.lit(1))
    else:
        rows = rows.join(before, "id", "left").withColumn("attempt", F.coalesce(F.col("__a"), F.lit(0)) + 1).drop("__a")
    rows.write.mode("append").parquet(path)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The last attempt of each id: a later result takes the place of one that wasn't completed."""
    rows = spark.read.parquet(path)
    last = rows.groupBy("id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "id"]), "attempt").alias("r"))
    return last.select("id", "r.*")


def to_do(members: DataFrame, path: str) -> DataFrame:
    """Members whose last attempt wasn't completed, or that have none."""
    try:
        done = current(members.sparkSession, path).filter("status = 'completed'").select("id")
    except AnalysisException:
        return members
    return members.join(done, "id", "left_anti")


def lock(spark: SparkSession, path: str, owner: str) -> bool:
    """Takes the store for one writer: false if another has it. A file that only one can create, wherever the store lies."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    file = jvm.org.apache.hadoop.fs.Path(f"{path}.lock")
    system = file.getFileSystem(conf)
    if system.exists(file):
        return holder(spark, path) == owner
    try:
        out = system.create(file, False)
    except Exception:  # another was first
        return False
    out.write(bytearray(owner.encode()))
    out.close()
    return True


def holder(spark: SparkSession, path: str) -> str | None:
    """Who holds the lock; None if nobody."""
    rows = spark.read.format("binaryFile").load(f"{path}.lock*").select("content").collect()
    return bytes(rows[0][0]).decode() if rows else None


def unlock(spark: SparkSession, path: str, owner: str) -> bool:
    if holder(spark, path) != owner:
        return False
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    file = jvm.org.apache.hadoop.fs.Path(f"{path}.lock")
    return file.getFileSystem(conf).delete(file, False)
