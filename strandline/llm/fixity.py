"""WARC files and a Merkle audit of their replicas.

Every record is hashed together with its place (offset and length) in its file; runs of `FAN` neighbours are hashed
level by level up to one root per file. A manifest has one row per file with all levels of its tree and is written
once. An audit joins the roots of two replicas; only the files whose roots differ give their levels, and of these only
the children of differing nodes are looked at, so equal files cost one comparison each. The records below differing
leaves are matched by id: damaged (another record hash), moved (the same record elsewhere in the file), missing or extra.

Manifests come from a table of pages, as the files that `write_warc` writes would have them, or from WARC files.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialise, small_batches

FAN = 16
#: Ids of a file, and the levels above the leaves.
FILE_RECORDS, LEVELS = 1024, 3
#: Records that a file holds, about, at most: ids that repeat often are dealt to several files (parts).
PART_RECORDS = 4096
#: Files that records without id are dealt to, at least.
NULL_FILES = 4096
#: Files with more than one part that are broadcast at most; more are joined by a shuffle.
MANY = 100_000
DATE = "2000-01-01T00:00:00Z"
FILE = ["archive", "part"]
MANIFEST = "archive long, part int, root string, levels array<array<string>>, records array<struct<record_no:long,record_id:string,offset:long,length:long,record_sha256:string>>"


def warc_record(url: Column, body: Column, record_id: Column) -> Column:
    """A resource record as text; null parts count as empty. Content-Length counts bytes in UTF-8."""
    body = F.coalesce(body, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Date: " + DATE + "\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def placed(pages: DataFrame, id_col: str, url_col: str, body_col: str, text: bool) -> DataFrame:
    """(id, archive, part, sha, length[, record]): which file a record is in; order within it is by id and hash.

    File a holds the ids from a · FILE_RECORDS; a null id goes to a file below 0 by a hash of its record. A file with more
    than PART_RECORDS records is cut into parts by a hash, for which its equal records are counted first and dealt out again
    in runs, so neither a repeated id nor a repeated record makes a file, or a task, that grows with the table.
    """
    record = warc_record(F.col(url_col), F.col(body_col), F.col(id_col))
    rows = pages.select(F.col(id_col).alias("id"), record.alias("record"))
    archive = F.coalesce(F.floor(F.col("id") / FILE_RECORDS).cast("long"), -1 - F.pmod(F.xxhash64("record"), F.lit(NULL_FILES)))
    rows = rows.select("id", archive.alias("archive"), F.sha2("record", 256).alias("sha"), F.octet_length("record").cast("long").alias("length"), *(["record"] if text else []))
    keys = rows.columns
    sizes = materialise(rows.groupBy("archive").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > PART_RECORDS), "large-files")
    many = sizes.count()
    if not many:
        return rows.withColumn("part", F.lit(0))
    large = F.broadcast(sizes) if many <= MANY else sizes
    met = rows.join(large, "archive").groupBy(*keys, "rows").agg(F.count(F.lit(1)).alias("n"))
    runs = met.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PART_RECORDS).cast("long"))))
    part = F.pmod(F.xxhash64("sha", "run"), F.ceil(F.col("rows") / PART_RECORDS).cast("long")).cast("int")
    held = F.least(F.col("n") - F.col("run") * PART_RECORDS, F.lit(PART_RECORDS))
    dealt = runs.withColumn("part", part).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), held))).select(*keys, "part")
    return rows.join(large, "archive", "left_anti").withColumn("part", F.lit(0)).unionByName(dealt)


def _trees(records: DataFrame, levels: int, fan: int) -> DataFrame:
    """One row per file from its records (archive, part, record_no, record_id, offset, length, record_sha256), as MANIFEST."""
    fields = ("record_no", "record_id", "offset", "length", "record_sha256")
    files = records.groupBy(*FILE).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("records"))
    leaf = lambda r: F.sha2(F.concat_ws(":", r["record_sha256"], r["offset"], r["length"]), 256)
    files = files.withColumn("level0", F.transform("records", leaf))
    for i in range(1, levels + 1):
        files = files.withColumn(f"level{i}", _level(F.col(f"level{i - 1}"), fan if i < levels else None))
    root = F.get(f"level{levels}", F.lit(0)).alias("root")
    return files.select(*FILE, root, F.array(*[F.col(f"level{i}") for i in range(levels)]).alias("levels"), "records")


def _level(below: Column, fan: int | None) -> Column:
    """The nodes above `below`: hashes of runs of `fan` of its hashes, or of all of them."""
    if fan is None:
        return F.array(F.sha2(F.array_join(below, ""), 256))
    starts = F.sequence(F.lit(0), F.ceil(F.size(below) / fan).cast("int") - 1)
    return F.transform(starts, lambda k: F.sha2(F.array_join(F.slice(below, k * fan + 1, F.lit(fan)), ""), 256))


def manifest(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", levels: int = LEVELS, fan: int = FAN) -> DataFrame:
    """One row per file that holds `pages`: archive, part, root, levels (hashes from the leaves up) and records. Written once.

    Null urls and bodies count as empty; repeated rows are records of their own; bodies of any length are hashed as a
    whole; other columns don't matter. An empty table gives no file.
    """
    rows = placed(pages, id_col, url_col, body_col, False)
    order = W.partitionBy(*FILE).orderBy(F.col("id").asc_nulls_first(), "sha")
    before = F.coalesce(F.sum("length").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    records = rows.select(
        *FILE, (F.row_number().over(order).cast("long") - 1).alias("record_no"), F.col("id").cast("string").alias("record_id"), before.alias("offset"), "length", F.col("sha").alias("record_sha256")
    )
    return materialise(_trees(records, levels, fan), "manifest")


def records_of(files: DataFrame) -> DataFrame:
    """(archive, part, record_no, record_id, offset, length, record_sha256, archive_root): a manifest's records."""
    one = files.select(*FILE, F.col("root").alias("archive_root"), F.explode("records").alias("r"))
    return one.select(*FILE, "r.record_no", "r.record_id", "r.offset", "r.length", "r.record_sha256", "archive_root")


def _below(side: str, levels: int, fan: int) -> Column:
    """Of a row with both replicas' levels (a, b): the numbers of the leaves of `side` under nodes that differ."""
    mine, other = ("a", "b") if side == "a" else ("b", "a")

    def differing(level: int, nodes: Column) -> Column:
        return F.filter(nodes, lambda n: ~F.get(F.get(mine, F.lit(level)), n).eqNullSafe(F.get(F.get(other, F.lit(level)), n)))

    def children(level: int, nodes: Column) -> Column:
        size = F.size(F.get(mine, F.lit(level)))
        return F.flatten(F.transform(nodes, lambda n: F.sequence(n * fan, F.least(n * fan + fan, size) - 1)))

    nodes = differing(levels - 1, F.transform(F.get(mine, F.lit(levels - 1)), lambda x, k: k))
    for i in range(levels - 2, -1, -1):
        nodes = differing(i, children(i, nodes))
    return nodes


def audit(first: DataFrame, second: DataFrame, levels: int = LEVELS, fan: int = FAN) -> DataFrame:
    """(archive, part, record_no, record_id, state): where two manifests differ.

    damaged: the record of this id has another hash in the second; moved: the same record lies elsewhere in the file;
    missing: only the first has it; extra: only the second, whose record_no it then is. Records that repeat an id within
    a file are matched by hash, and the rest in their order. Equal manifests give no row, nor do empty ones.
    """
    roots = first.select(*FILE, F.col("root").alias("ra")).join(second.select(*FILE, F.col("root").alias("rb")), FILE, "full")
    todo = materialise(roots.filter(~F.col("ra").eqNullSafe(F.col("rb"))).select(*FILE), "differing")
    a = first.join(todo, FILE, "left_semi").select(*FILE, F.col("levels").alias("a"), F.col("records").alias("x"))
    b = second.join(todo, FILE, "left_semi").select(*FILE, F.col("levels").alias("b"), F.col("records").alias("y"))
    both = materialise(a.join(b, FILE, "full"), "differing-files")

    def side(name: str, records: str) -> DataFrame:
        nothing = F.array().cast("array<int>")
        leaves = F.when(F.col(name).isNull(), nothing).when(F.col("b" if name == "a" else "a").isNull(), F.transform(F.get(name, F.lit(0)), lambda x, k: k)).otherwise(_below(name, levels, fan))
        rows = both.select(*FILE, F.explode(F.transform(leaves, lambda n: F.get(records, n))).alias("r"))
        again = W.partitionBy(*FILE, "r.record_id", "r.record_sha256").orderBy("r.record_no")
        return rows.select(*FILE, F.coalesce("r.record_id", F.lit("")).alias("id"), F.col("r.record_sha256").alias("sha"), F.row_number().over(again).alias("copy"), F.col("r.record_no").alias("no"), F.col("r.offset").alias("offset"))

    def paired(x: DataFrame, y: DataFrame, on: list[str]) -> DataFrame:
        y = y.select(*FILE, *on, F.col("no").alias("no2"), F.col("offset").alias("offset2"), F.lit(True).alias("there"))
        return x.withColumn("here", F.lit(True)).join(y, [*FILE, *on], "full")

    exact = paired(side("a", "x"), side("b", "y"), ["id", "sha", "copy"])
    moved = exact.filter("here AND there AND (no <> no2 OR offset <> offset2)").select(*FILE, "no", "id", F.lit("moved").alias("state"))
    inorder = W.partitionBy(*FILE, "id").orderBy("no")
    left = exact.filter("there IS NULL").withColumn("copy", F.row_number().over(inorder)).select(*FILE, "id", "copy", "no", "offset")
    right = exact.filter("here IS NULL").select(*FILE, "id", F.col("no2").alias("no"), F.col("offset2").alias("offset")).withColumn("copy", F.row_number().over(inorder))
    state = F.when(F.col("there").isNull(), "missing").when(F.col("here").isNull(), "extra").otherwise("damaged")
    rest = paired(left, right, ["id", "copy"]).select(*FILE, F.coalesce("no", "no2").alias("no"), "id", state.alias("state"))
    return moved.unionByName(rest).select(*FILE, F.col("no").alias("record_no"), F.col("id").alias("record_id"), "state")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", compression: str = "none") -> None:
    """The pages as WARC files through Spark's own writer, one folder per file, records in the manifest's order.

    compression: none or gzip (a whole file as one member). See manifest for nulls, repeats and empty tables.
    """
    rows = placed(pages, id_col, url_col, body_col, True)
    value = F.substring("record", F.lit(1), F.length("record") - 1).alias("value")  # the writer ends each row with its last line feed
    sorted_rows = rows.repartition(*FILE).sortWithinPartitions(*FILE, F.col("id").asc_nulls_first(), "sha")
    sorted_rows.select(value, *FILE).write.partitionBy(*FILE).option("lineSep", "\n").option("compression", compression).option("maxRecordsPerFile", 0).mode("overwrite").text(path)


def _unpacked(data: bytes) -> bytes:
    """All gzip members, one after the other; other files as they are. What doesn't unpack stays as it is."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data) + member.flush())
        except zlib.error:
            return b"".join([*out, data])
        data = member.unused_data
    return b"".join(out)


def split_warc(data: bytes) -> Iterator[tuple[int, int, dict[bytes, bytes] | None, bytes]]:
    """(offset, length, header fields in lower case, body) of each record. A range that isn't a record is given as one,
    with None for its fields: up to the next record's start, or to the end. Nothing is left out."""
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at) if data.startswith(b"WARC/", at) else -1
        lines = data[at:head].split(b"\r\n")[1:] if head >= 0 else []
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in lines)}
        size = fields.get(b"content-length", b"")
        end = head + 4 + int(size) + 4 if size.isdigit() else -1
        if head < 0 or end < 0 or end > len(data) or data[end - 4 : end] != b"\r\n\r\n":
            after = data.find(b"\r\n\r\nWARC/", at + 1)
            end = after + 4 if after >= 0 else len(data)
            yield at, end - at, None, data[at:end]
        else:
            yield at, end - at, fields, data[head + 4 : end - 4]
        at = end


def _binary(spark: SparkSession, path: str) -> DataFrame:
    small_batches(spark)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, length, url, body as binary): the records of all WARC files below `path`, gzip members unpacked.

    Header names may be in any case. A range that isn't a record has null url and is its own body.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                rows = [(name, at, size, f.get(b"warc-target-uri", b"").decode("utf-8", "replace") if f is not None else None, body) for at, size, f, body in split_warc(_unpacked(data.as_py()))]
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["file", "offset", "length", "url", "body"])

    return _binary(spark, path).mapInArrow(parse, "file string, offset long, length long, url string, body binary")


def warc_manifest(spark: SparkSession, path: str, levels: int = LEVELS, fan: int = FAN) -> DataFrame:
    """The manifest of WARC files below `path`: raw record bytes are hashed with their offset and length. Written once.

    Files are told apart by the folders archive=…/part=… that write_warc makes; others by a hash of their path below it.
    Ranges that aren't records are kept as records without an id.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                raw = _unpacked(data.as_py())
                marks = dict(x.split("=", 1) for x in name.split("/") if "=" in x)
                if "archive" in marks:
                    archive, part = int(marks["archive"]), int(marks.get("part", 0))
                else:
                    archive, part = int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "little", signed=True), 0
                rows = []
                for at, size, fields, _ in split_warc(raw):
                    tag = (fields or {}).get(b"warc-record-id", b"").decode("utf-8", "replace").removeprefix("<urn:page:").removesuffix(">")
                    rows.append((len(rows), tag or None, at, size, hashlib.sha256(raw[at : at + size]).hexdigest()))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                arrays = [pa.array([archive] * len(rows), pa.int64()), pa.array([part] * len(rows), pa.int32()), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))]
                yield pa.RecordBatch.from_arrays(arrays, [*FILE, "record_no", "record_id", "offset", "length", "record_sha256"])

    found = _binary(spark, path).mapInArrow(parse, "archive long, part int, record_no long, record_id string, offset long, length long, record_sha256 string")
    return materialise(_trees(found, levels, fan), "manifest")
