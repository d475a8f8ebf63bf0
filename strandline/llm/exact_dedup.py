"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Three stages, each of which compares digest and full content, so equal digests of different texts never merge:

1. local: the map side of the first aggregation merges equal texts within a task;
2. salted: a task's winners meet by (salt, digest, content). The salt of a hot digest is the number of the task that the
   winner comes from, modulo the number of salts; other digests have one salt;
3. global: the salt winners of hot digests meet by (digest, content); of the others the salt winner is the winner.

Hot digests are the `HOT` most frequent ones with more than `HOT_ROWS` rows, known from a count of digests without
texts. Any other group is smaller than a `HOT`-th of the table, so it needs no salt. A text crosses the network once,
but for the salt winners of hot digests. Winners come back to the rows by (digest, salt), without texts, the salt now
being a hash of the row's id. Should one digest stand for several contents, which the written winners show, rows and
winners are joined by content as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Parts that a hot group is dealt to, at least; a cluster with many shuffle partitions uses a quarter of their number.
SALTS = 16
#: Digests that are salted, at most, and the rows that such a digest has at least.
HOT, HOT_ROWS = 1000, 256
#: ASCII white space, as the contract has it.
BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Every run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def _sha(content: Column) -> Column:
    return F.sha2(content, 256)


def _keyed(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column], made: list[Column]) -> DataFrame:
    content = normalised(F.col(text_col).cast("string"))
    return docs.select(*made, F.col(id_col).alias("__id"), content.alias("__content")).withColumn("__digest", digest(F.col("__content")))


def _hot(rows: DataFrame) -> DataFrame:
    """(__digest, __hot): HOT rows at most, so it may be broadcast."""
    found = rows.groupBy("__digest").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_ROWS).orderBy(F.desc("n"), "__digest").limit(HOT)
    return F.broadcast(materialise(found.select("__digest", F.lit(True).alias("__hot")), "hot"))


def _salts(docs: DataFrame, salts: int | None) -> int:
    return salts or max(SALTS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)


def _combine(rows: DataFrame, hot: DataFrame, salts: int, first: Callable[[str], Column]) -> DataFrame:
    """(__digest, __content, __first, __n, __hot): one row per text; `first` aggregates __one, what stays of a group."""
    salt = F.when(F.col("__hot"), F.pmod(F.spark_partition_id(), F.lit(salts))).otherwise(F.lit(0))
    local = rows.join(hot, "__digest", "left").withColumn("__salt", salt)
    # __hot depends on the digest alone; as an aggregate it lets both branches below share one exchange of the texts
    is_hot = F.coalesce(F.first("__hot"), F.lit(False)).alias("__hot")
    salted = local.groupBy("__salt", "__digest", "__content").agg(first("__one").alias("__one"), F.count(F.lit(1)).alias("__n"), is_hot)
    names = ["__digest", "__content", "__one", "__n", "__hot"]
    met = salted.filter("__hot").groupBy("__digest", "__content").agg(first("__one").alias("__one"), F.sum("__n").alias("__n"), F.first("__hot").alias("__hot"))
    return salted.filter("NOT __hot").select(names).unionByName(met.select(names))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = _sha,
    salts: int | None = None,
) -> DataFrame:
    """All columns of `docs` (those named as below replaced), and of each row's group of equal texts:

    keep_id (the smallest id; null where all ids are null, as nulls count only then), group_size, kept (the row's
    id is keep_id) and text_sha256. A null text counts as empty; empty texts form a group like any other. Rows that
    repeat both id and text carry the same decision: `exact_dedup` leaves one of them. An empty table gives an
    empty result. Texts of any length are compared as a whole.
    """
    made = ["keep_id", "group_size", "kept", "text_sha256"]
    salts = _salts(docs, salts)
    plain = docs.drop(*made)
    rows = _keyed(docs, id_col, text_col, digest, [F.struct(*plain.columns).alias("__row"), F.col(id_col).alias("__one")])
    hot = _hot(rows)
    combined = _combine(rows.drop("__row"), hot, salts, F.min)
    winners = materialise(combined.drop("__content"), "winners")
    clash = winners.groupBy("__digest").count().filter("count > 1").limit(1).count() > 0
    keys = ["__digest", "__salt"]
    if clash:
        keys, winners = [*keys, "__content"], combined
    copies = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    winners = winners.select(*[k for k in keys if k != "__salt"], F.explode(copies).alias("__salt"), F.col("__one").alias("keep_id"), F.col("__n").alias("group_size"))
    mine = F.when(F.col("__hot"), F.pmod(F.xxhash64("__id"), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    text_sha = F.col("__digest") if digest is _sha else F.sha2("__content", 256)
    tagged = rows.join(hot, "__digest", "left").withColumns({"__salt": mine, "text_sha256": text_sha})
    found = tagged.join(winners, keys, "inner").withColumn("kept", F.col("__id").eqNullSafe(F.col("keep_id")))
    return found.select(*[F.col("__row")[c].alias(c) for c in plain.columns], *made)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, all columns as they were: of equal texts the row with the smallest id, once.

    Null ids count only where all of a group are null. Of rows that repeat both id and text one stays; their other
    columns, if they differ, are those of one of them. Null and empty texts are one group. The winner carries its row
    through the three stages, so a text crosses the network once. An empty table gives an empty result.
    """
    text, names = F.col(text_col), [c for c in docs.columns if c != text_col]
    same = text.cast("string").eqNullSafe(normalised(text.cast("string")))
    one = F.struct(
        F.struct(F.col(id_col).isNull().alias("no"), F.col(id_col).alias("id")).alias("key"),
        F.when(~same, text).alias("raw"),  # the text, where it isn't the content itself
        same.alias("same"),
        F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)]).alias("rest"),
    )
    rows = _keyed(docs, id_col, text_col, _sha, [one.alias("__one")])
    kept = _combine(rows.drop("__id"), _hot(rows), _salts(docs, None), lambda c: F.min_by(c, F.col(c)["key"]))
    found = F.col("__one")
    back = {c: found["rest"][f"c{i}"] for i, c in enumerate(names)}
    back[text_col] = F.when(found["same"], F.col("__content").cast(docs.schema[text_col].dataType)).otherwise(found["raw"])
    return kept.select(*[back[c].alias(c) for c in docs.columns])
