"""What several operators share: shared-folder writes, Arrow batch sizes, labels and held-out rows."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Rows and bytes that an Arrow batch holds at most: long texts come in small batches, so a worker's memory stays bounded.
#: (A batch holds one row at least, so a single text beyond BATCH_BYTES comes alone.)
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20

_WRITTEN: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where none is set, one of this machine if there are no other machines (as in
    tests); else an error, as executors would write where nobody else reads."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, remembered for release()."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _WRITTEN:
        _WRITTEN[app] = []
        atexit.register(_at_end, spark)
    _WRITTEN[app].append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` to the shared folder as Parquet and reads it back: cuts lineage, survives lost executors.

    The files go with drop_materialised(), with release() or at the driver's end.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def drop_materialised(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes what materialise() wrote, once nothing lazy refers to it any more."""
    names = {f.rsplit("/", 1)[0] for df in frames for f in df.inputFiles()}
    delete(spark, sorted(names))
    app = spark.sparkContext.applicationId
    gone = {n.rsplit("/", 1)[1] for n in names}
    _WRITTEN[app] = [p for p in _WRITTEN.get(app, []) if p.rsplit("/", 1)[1] not in gone]


def written(spark: SparkSession) -> int:
    """How many paths release() would delete; what is written later has a higher place."""
    return len(_WRITTEN.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, since: int = 0) -> None:
    """Deletes the intermediate tables written since then; call it when the results made from them are written."""
    if spark.sparkContext._jsc is None:  # a stopped session
        return
    paths = _WRITTEN.get(spark.sparkContext.applicationId, [])
    delete(spark, paths[since:])
    del paths[since:]


def _at_end(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the JVM may have ended before
        release(spark)


def small_batches(spark: SparkSession) -> None:
    """Before Python runs on the executors: the package goes there, and Arrow batches are bounded in rows and bytes.

    The two settings are the session's, the same for all operators here, so it doesn't matter which plan runs when.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def remainder(key: Column | str, mod: int) -> Column:
    """crc32 of the id as text, modulo `mod`: the fold a document belongs to. A null id counts as empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def fraction_filter(key: Column, fraction: float, seed: str = "fit") -> Column:
    """Keeps about `fraction` of the rows, chosen by a hash of the key: the same rows in every run. A null key counts as empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.xxhash64(text, F.lit(seed)), F.lit(1_000_000)) < F.lit(int(round(fraction * 1_000_000)))
