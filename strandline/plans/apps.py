"""Composable apps: typed steps over DataFrames with an error column instead of failed jobs.

A step maps rows of (id, data…) to rows; `a + b` runs b on what a completed. Row functions run in Arrow batches: an
exception, or a NotCompleted value, turns into the row's `error` struct (type, origin, message, source), and rows with
an error pass through later steps untouched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

ERROR = T.StructType([T.StructField(n, T.StringType()) for n in ("type", "origin", "message", "source")])
KINDS = ("loader", "generic", "writer", "non_composable")


@dataclass
class NotCompleted:
    """A false value that says why: type is ERROR, FAIL, FALSE or BUG."""

    type: str
    origin: str
    message: str
    source: str | None = None

    def __bool__(self) -> bool:
        return False


@dataclass
class App:
    name: str
    run: Callable[[DataFrame], DataFrame]
    kind: str = "generic"
    takes: str = "any"
    gives: str = "any"
    doc: str = ""
    steps: list[App] = field(default_factory=list)

    def __call__(self, df: DataFrame) -> DataFrame:
        """Rows without an error go through; those with one are kept as they are."""
        if "error" not in df.columns:
            df = df.withColumn("error", F.lit(None).cast(ERROR))
        done = self.run(df.filter("error IS NULL"))
        if "error" not in done.columns:
            done = done.withColumn("error", F.lit(None).cast(ERROR))
        return done.unionByName(df.filter("error IS NOT NULL"), allowMissingColumns=True)

    def __add__(self, other: App) -> App:
        if self.kind == "writer" or other.kind == "loader" or "non_composable" in (self.kind, other.kind):
            raise TypeError(f"{self.name} ({self.kind}) and {other.name} ({other.kind}) don't compose")
        if "any" not in (self.gives, other.takes) and self.gives != other.takes:
            raise TypeError(f"{other.name} takes {other.takes}, {self.name} gives {self.gives}")
        steps = [*(self.steps or [self]), *(other.steps or [other])]
        kind = other.kind if other.kind == "writer" else self.kind
        return App(f"{self.name} + {other.name}", lambda df: other(self(df)), kind, self.takes, other.gives, steps=steps)


REGISTRY: dict[str, Callable[..., App]] = {}


def define_app(name: str | None = None, kind: str = "generic", takes: str = "any", gives: str = "any"):
    """Registers a factory: a function of options that returns a DataFrame-to-DataFrame function."""
    if kind not in KINDS:
        raise ValueError(kind)

    def add(f: Callable[..., Callable[[DataFrame], DataFrame]]):
        key = name or f.__name__

        def make(*args, **options) -> App:
            return App(key, f(*args, **options), kind, takes, gives, f.__doc__ or "")

        make.__doc__ = f.__doc__
        REGISTRY[key] = make
        return make

    return add


def get_app(name: str, *args, **options) -> App:
    return REGISTRY[name](*args, **options)


def available_apps(spark: SparkSession, name_filter: str | None = None) -> DataFrame:
    rows = [(n, (f.__doc__ or "").strip().split("\n")[0]) for n, f in sorted(REGISTRY.items()) if not name_filter or name_filter in n]
    return spark.createDataFrame(rows, "name string, doc string")


def app_help(name: str) -> str:
    return REGISTRY[name].__doc__ or ""


def row_app(name: str, f: Callable[[Any], Any], column: str, out: str = "string", source: str = "id") -> App:
    """A step from a function of one value. None from it is a BUG; exceptions are ERRORs; NotCompleted is taken over."""

    def run(df: DataFrame) -> DataFrame:
        ship(df.sparkSession)

        def one(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            for values, ids in frames:
                rows = []
                for v, i in zip(values, ids):
                    try:
                        r = f(v)
                    except Exception as e:  # every failure becomes the row's error
                        r = NotCompleted("ERROR", name, f"{type(e).__name__}: {e}", str(i))
                    if r is None:
                        r = NotCompleted("BUG", name, "unexpected output value None", str(i))
                    bad = isinstance(r, NotCompleted)
                    rows.append((None if bad else r, (r.type, r.origin, r.message, r.source or str(i)) if bad else None))
                yield pd.DataFrame({"value": [r[0] for r in rows], "error": [r[1] and dict(zip(ERROR.names, r[1])) for r in rows]})

        apply = F.pandas_udf(one, T.StructType([T.StructField("value", T._parse_datatype_string(out)), T.StructField("error", ERROR)]))
        made = df.drop("error").withColumn("__r", apply(F.col(column), F.col(source).cast("string")))
        return made.withColumns({column: F.col("__r.value"), "error": F.col("__r.error")}).drop("__r")

    return App(name, run)


def gate(name: str, test, message: str, source: str = "id") -> App:
    """Rows for which the condition is false become FALSE failures."""

    def run(df: DataFrame) -> DataFrame:
        bad = F.struct(F.lit("FALSE").alias("type"), F.lit(name).alias("origin"), F.lit(message).alias("message"), F.col(source).cast("string").alias("source"))
        return df.withColumn("error", F.when(~F.coalesce(test, F.lit(False)), bad.cast(ERROR)))

    return App(name, run)


def summary_not_completed(df: DataFrame, examples: int = 3) -> DataFrame:
    """Failures by type, origin and message, with a few sources: the smallest, kept by a bounded aggregate."""
    bad = df.filter("error IS NOT NULL").select("error.*")
    return bad.groupBy("type", "origin", "message").agg(F.count(F.lit(1)).alias("num"), F.min("source").alias("example"))


def apply_to(app: App, members: DataFrame, done: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """The app over a store's members, without those that `done` has."""
    todo = members if done is None else members.join(done.select(id_col).distinct(), id_col, "left_anti")
    return app(todo)


def write_tabular(df: DataFrame, path: str, style: str = "tsv") -> None:
    """Completed rows as delimited files, by Spark."""
    from ..operators.table import write_table

    rows = df.filter("error IS NULL").drop("error") if "error" in df.columns else df
    write_table(rows, path, style)


def write_json(df: DataFrame, path: str) -> None:
    """Rows, failures too, as lines of JSON."""
    df.write.mode("overwrite").json(path)


def load_json(spark, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


# built-in steps over collections as rows (id, name, ord, seq)
def _register() -> None:
    from ..functions.genetic_code import get_code
    from ..functions.moltype import DNA
    from ..operators import alignment as A
    from ..operators import distance as D

    simple = {
        "omit_degenerates": lambda **o: lambda df: A.no_degenerates(df, **o),
        "omit_gap_pos": lambda **o: lambda df: A.omit_gap_pos(df, **o),
        "take_codon_positions": lambda *p, **o: lambda df: A.take_codon_positions(df, p or (3,), **o),
        "take_named_seqs": lambda *names, **o: lambda df: A.take_seqs(df, names, **o),
        "take_n_seqs": lambda n, **o: lambda df: df.orderBy("ord", "name").limit(n),
        "fixed_length": lambda n, **o: lambda df: A.fixed_length(df, n, **o),
        "omit_bad_seqs": lambda **o: lambda df: A.omit_bad_seqs(df, **o),
        "omit_duplicated": lambda **o: lambda df: A.omit_duplicated(df, **o),
        "trim_stop_codons": lambda gc=1: lambda df: A.per_seq(df, get_code(gc).trim_stop),
        "translate_seqs": lambda gc=1, **o: lambda df: A.per_seq(df, lambda s: get_code(gc).get_translation(s, **o)),
        "degap_seqs": lambda: lambda df: A.per_seq(df, DNA.degap),
        "select_translatable": lambda gc=1, allow_rc=False: lambda df: _translatable(df, get_code(gc), allow_rc),
        "jaccard_dist": lambda k=10: lambda df: D.jaccard_dist(df, k),
        "approx_pdist": lambda: D.approx_pdist,
        "approx_jc69": lambda states=4: lambda df: D.approx_jc69(df, states),
        "fast_slow_dist": lambda calc="jc69": lambda df: D.distance_matrix(df, calc),
        "gap_dist": lambda insert=12.0, extend=1.0: lambda df: D.gap_dist(df, insert, extend),
    }
    docs = {
        "omit_degenerates": "drops columns with codes or gaps", "omit_gap_pos": "drops columns with too many gaps", "take_codon_positions": "keeps places of codons",
        "take_named_seqs": "keeps named sequences", "take_n_seqs": "keeps the first n sequences", "fixed_length": "cuts sequences to one length", "omit_bad_seqs": "drops sequences that cause gaps",
        "omit_duplicated": "drops repeated sequences", "trim_stop_codons": "drops terminal stops", "translate_seqs": "translates", "degap_seqs": "drops gaps",
        "select_translatable": "turns sequences to their best frame", "jaccard_dist": "k-mer Jaccard distances", "approx_pdist": "Jaccard to proportion", "approx_jc69": "proportion to JC69",
        "fast_slow_dist": "pairwise distances", "gap_dist": "distances of gap patterns",
    }
    for key, factory in simple.items():
        factory.__doc__ = docs[key]
        define_app(key)(factory)


def _translatable(df: DataFrame, gc, allow_rc: bool) -> DataFrame:
    from ..functions.moltype import DNA

    frame = gc.best_frame("seq", allow_rc)
    rows = df.withColumn("__f", frame).filter("__f IS NOT NULL")
    turned = F.when(F.col("__f") < 0, DNA.rc("seq")).otherwise(F.col("seq"))
    return rows.withColumn("seq", F.substring(turned, F.abs("__f"), F.length("seq"))).drop("__f")


_register()
