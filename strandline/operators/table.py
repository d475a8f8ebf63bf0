"""Table operators over DataFrames: columns, filters, joins, counts, sums, normalisation, reshaping and text forms."""

from __future__ import annotations

import ast
import html
import json
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

Predicate = Column | str | Callable[[DataFrame], Column]

_OPS = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Mod: "%", ast.Eq: "=", ast.NotEq: "<>", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">="}


def python_to_sql(text: str) -> str:
    """A Python expression over column names as SQL; only names, constants, arithmetic, comparisons, and/or/not, in, len, abs.

    Callbacks given as text are translated, never evaluated.
    """

    def walk(n: ast.AST) -> str:
        match n:
            case ast.Expression(body):
                return walk(body)
            case ast.BoolOp(op, values):
                return "(" + (" AND " if isinstance(op, ast.And) else " OR ").join(map(walk, values)) + ")"
            case ast.UnaryOp(ast.Not(), x):
                return f"(NOT {walk(x)})"
            case ast.UnaryOp(ast.USub(), x):
                return f"(-{walk(x)})"
            case ast.BinOp(a, op, b) if type(op) in _OPS:
                return f"({walk(a)} {_OPS[type(op)]} {walk(b)})"
            case ast.Compare(a, ops, rest):
                parts, left = [], walk(a)
                for op, r in zip(ops, rest):
                    if isinstance(op, ast.In | ast.NotIn):
                        word = "IN" if isinstance(op, ast.In) else "NOT IN"
                        parts.append(f"{left} {word} ({', '.join(map(walk, r.elts))})")
                        continue
                    right = walk(r)
                    parts.append(f"{left} {_OPS[type(op)]} {right}")
                    left = right
                return "(" + " AND ".join(parts) + ")"
            case ast.Call(ast.Name("len"), [x]):
                return f"length({walk(x)})"
            case ast.Call(ast.Name("abs"), [x]):
                return f"abs({walk(x)})"
            case ast.Name(name):
                return f"`{name}`"
            case ast.Constant(bool() as v):
                return str(v).upper()
            case ast.Constant(None):
                return "NULL"
            case ast.Constant(str() as v):
                return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
            case ast.Constant(v):
                return repr(v)
        raise ValueError(f"not supported in an expression: {ast.dump(n)}")

    return walk(ast.parse(text, mode="eval"))


def predicate(df: DataFrame, p: Predicate) -> Column:
    return p if isinstance(p, Column) else F.expr(python_to_sql(p)) if isinstance(p, str) else p(df)


def names(columns: str | Sequence[str] | None, df: DataFrame) -> list[str]:
    return list(df.columns) if columns is None else [columns] if isinstance(columns, str) else list(columns)


def quoted(c: str) -> Column:
    return F.col("`" + c.replace("`", "``") + "`")


# making
def make_table(spark: SparkSession, header: Sequence[str] | None = None, data=None, schema: T.StructType | str | None = None) -> DataFrame:
    """From rows with a header, or from a dict of columns."""
    if isinstance(data, dict):
        header, data = header or list(data), list(zip(*(data[c] for c in header or data)))
    return spark.createDataFrame([tuple(r) for r in data], schema or list(header))


def cast_ladder(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """String columns whose values all read as integers become long, else as numbers double; others stay. One pass decides."""
    text = [c for c in names(columns, df) if df.schema[c].dataType == T.StringType()]
    if not text:
        return df
    full = [F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(text)]
    ints = [F.count(F.expr(f"CASE WHEN `{c}` RLIKE '^\\\\s*[+-]?[0-9]+\\\\s*$' THEN try_cast(`{c}` AS bigint) END")).alias(f"i{i}") for i, c in enumerate(text)]
    nums = [F.count(F.expr(f"try_cast(`{c}` AS double)")).alias(f"d{i}") for i, c in enumerate(text)]
    seen = df.agg(*full, *ints, *nums).first().asDict()
    kinds = {c: "long" if seen[f"n{i}"] == seen[f"i{i}"] > 0 else "double" if seen[f"n{i}"] == seen[f"d{i}"] > 0 else None for i, c in enumerate(text)}
    return df.withColumns({c: quoted(c).cast(k) for c, k in kinds.items() if k})


# columns and rows
def get_columns(df: DataFrame, columns: str | Sequence[str], index: str | None = None) -> DataFrame:
    wanted = names(columns, df)
    return df.select(*[quoted(c) for c in ([index] if index and index not in wanted else []) + wanted])


def filtered(df: DataFrame, p: Predicate, negate: bool = False) -> DataFrame:
    c = predicate(df, p)
    return df.filter(~c if negate else c)


def row_mask(df: DataFrame, p: Predicate, negate: bool = False) -> DataFrame:
    c = predicate(df, p)
    return df.withColumn("mask", ~c if negate else c)


def count(df: DataFrame, p: Predicate) -> DataFrame:
    return df.agg(F.count_if(predicate(df, p)).alias("n"))


def filtered_by_column(df: DataFrame, test: Callable[[Column], Column]) -> DataFrame:
    """The columns for which an aggregate test is true; one pass over the rows."""
    kept = df.agg(*[test(quoted(c)).alias(c) for c in df.columns]).first()
    return df.select(*[quoted(c) for c in df.columns if kept[c]])


def count_unique(df: DataFrame, columns: str | Sequence[str] | None = None) -> DataFrame:
    return df.groupBy(*[quoted(c) for c in names(columns, df)]).agg(F.count(F.lit(1)).alias("count"))


def distinct_values(df: DataFrame, columns: str | Sequence[str] | None = None) -> DataFrame:
    return df.select(*[quoted(c) for c in names(columns, df)]).distinct()


def with_new_column(df: DataFrame, name: str, value: Predicate, dtype: str | None = None) -> DataFrame:
    """The column goes last, also where it replaces one."""
    c = predicate(df, value)
    return df.withColumn("__new", c.cast(dtype) if dtype else c).drop(name).withColumnRenamed("__new", name)


def with_new_header(df: DataFrame, old: str | Sequence[str], new: str | Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed(dict(zip(names(old, df), names(new, df))))


# joins
def inner_join(left: DataFrame, right: DataFrame, on_left: str | Sequence[str] | None = None, on_right: str | Sequence[str] | None = None, prefix: str = "right_") -> DataFrame:
    """Rows with equal keys, nulls equal to nulls; the right side's other columns carry the prefix, its keys are dropped.

    Without keys all columns of one name on both sides are keys.
    """
    if on_left is None and on_right is None:
        on_left = on_right = [c for c in left.columns if c in right.columns]
    a, b = names(on_left if on_left is not None else on_right, left), names(on_right if on_right is not None else on_left, right)
    if len(a) != len(b):
        raise ValueError("as many keys on one side as on the other")
    keys = [f"__key{i}" for i in range(len(b))]
    r = right.select(*[quoted(c).alias(k) for c, k in zip(b, keys)], *[quoted(c).alias(prefix + c) for c in right.columns if c not in b])
    on = reduce(lambda x, y: x & y, [left[f"`{c}`"].eqNullSafe(r[k]) for c, k in zip(a, keys)])
    return left.join(r, on, "inner").drop(*keys)


def cross_join(left: DataFrame, right: DataFrame, prefix: str = "right_") -> DataFrame:
    """Every pair of rows; an empty side gives an empty result."""
    return left.crossJoin(right.toDF(*[prefix + c for c in right.columns]))


def joined(left: DataFrame, right: DataFrame, on_left=None, on_right=None, inner: bool = True, prefix: str = "right_") -> DataFrame:
    return inner_join(left, right, on_left, on_right, prefix) if inner else cross_join(left, right)


def appended(first: DataFrame, *others: DataFrame, new_column: str | None = None, titles: Sequence[str] = ()) -> DataFrame:
    """The rows of all tables, matched by column name; `new_column`, in front, names the table that a row is from."""
    tables = [first, *others]
    if any(set(t.columns) != set(first.columns) for t in others):
        raise ValueError("columns differ")
    if new_column:
        tables = [t.select(F.lit(n).alias(new_column), "*") for t, n in zip(tables, [*titles, *map(str, range(len(titles), len(tables)))])]
    return reduce(DataFrame.unionByName, tables)


# order
def sort(df: DataFrame, columns: str | Sequence[str] | None = None, reverse: str | Sequence[str] | None = None) -> DataFrame:
    """By the columns in turn, those of `reverse` downwards; all others break ties, so the order is always the same."""
    down = names(reverse, df) if reverse is not None else []
    first = names(columns, df) if columns is not None else down or list(df.columns)
    first += [c for c in down if c not in first]
    rest = [c for c in df.columns if c not in first]
    return df.orderBy(*[quoted(c).desc() if c in down else quoted(c).asc() for c in first], *[quoted(c).asc() for c in rest])


def head(df: DataFrame, n: int, order: str | Sequence[str]) -> DataFrame:
    return df.orderBy(*names(order, df)).limit(n)


def tail(df: DataFrame, n: int, order: str | Sequence[str]) -> DataFrame:
    return df.orderBy(*[quoted(c).desc() for c in names(order, df)]).limit(n)


# sums
def _number(df: DataFrame, c: str, strict: bool) -> Column:
    return quoted(c).cast("double") if strict else F.expr(f"try_cast(`{c}` AS double)")


def sum_columns(df: DataFrame, columns: str | Sequence[str] | None = None, strict: bool = True) -> DataFrame:
    return df.agg(*[F.sum(_number(df, c, strict)).alias(c) for c in names(columns, df)])


def sum_rows(df: DataFrame, columns: str | Sequence[str] | None = None, strict: bool = True, to: str = "sum") -> DataFrame:
    parts = [_number(df, c, strict) for c in names(columns, df)]
    return df.withColumn(to, reduce(lambda a, b: a + b, parts if strict else [F.coalesce(p, F.lit(0.0)) for p in parts]))


def summed(df: DataFrame, columns=None, by_column: bool = True, strict: bool = True) -> DataFrame:
    return sum_columns(df, columns, strict) if by_column else sum_rows(df, columns, strict)


def normalized(df: DataFrame, columns: Sequence[str], by_row: bool = True, denominator: Callable[[Sequence[Column]], Column] | None = None) -> DataFrame:
    """Each cell over its row's (or column's) sum, or another denominator. By column: one aggregate row, broadcast."""
    if by_row:
        cells = [quoted(c) for c in columns]
        under = denominator(cells) if denominator else reduce(lambda a, b: a + b, cells)
        return df.withColumn("__under", under).withColumns({c: quoted(c) / F.col("__under") for c in columns}).drop("__under")
    agg = df.agg(*[(denominator([quoted(c)]) if denominator else F.sum(quoted(c))).alias(f"__under{i}") for i, c in enumerate(columns)])
    return df.crossJoin(F.broadcast(agg)).withColumns({c: quoted(c) / F.col(f"__under{i}") for i, c in enumerate(columns)}).drop(*agg.columns)


# reshaping
#: Columns that transposed() makes at most.
MOST_COLUMNS = 10_000


def transposed(df: DataFrame, new_column: str, header: str | None = None) -> DataFrame:
    """The column `header`, whose values must differ, becomes the header; the other columns become rows named in `new_column`.

    A table of more than MOST_COLUMNS rows is an error.
    """
    header = header or df.columns[0]
    values = [r[0] for r in df.select(quoted(header)).limit(MOST_COLUMNS + 1).collect()]
    if len(values) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} rows can't become columns")
    if len(set(values)) != len(values):
        raise ValueError(f"values of {header} repeat")
    rest = [c for c in df.columns if c != header]
    long = df.unpivot([quoted(header)], [quoted(c) for c in rest], new_column, "__value")
    return long.groupBy(new_column).pivot(header, values).agg(F.first("__value"))


def long_matrix(df: DataFrame, row: str, columns: Sequence[str], col_name: str = "col", value: str = "value") -> DataFrame:
    """A wide matrix as (row, col, value)."""
    return df.unpivot([quoted(row)], [quoted(c) for c in columns], col_name, value).withColumnRenamed(row, "row")


def wide_matrix(long: DataFrame, row: str = "row", col_name: str = "col", value: str = "value", columns: list | None = None) -> DataFrame:
    return long.groupBy(row).pivot(col_name, columns).agg(F.first(value))


def matrix_normalized(long: DataFrame, by: str | None = "row", value: str = "value") -> DataFrame:
    """Cells of a long matrix over the sum of their row, of their column, or of all (by=None)."""
    if by:
        return long.withColumn(value, F.col(value) / F.sum(value).over(W.partitionBy(by)))
    return long.crossJoin(F.broadcast(long.agg(F.sum(value).alias("__all")))).withColumn(value, F.col(value) / F.col("__all")).drop("__all")


def matrix_sums(long: DataFrame, by: str = "row", value: str = "value") -> DataFrame:
    return long.groupBy(by).agg(F.sum(value).alias(value))


def symmetric(long: DataFrame, a: str = "name1", b: str = "name2", value: str = "dist", diagonal: float | None = 0.0) -> DataFrame:
    """Pairs both ways round, with a diagonal."""
    swapped = long.select(F.col(b).alias(a), F.col(a).alias(b), value)
    out = long.select(a, b, value).unionByName(swapped)
    if diagonal is not None:
        out = out.unionByName(out.select(a).distinct().select(a, F.col(a).alias(b), F.lit(diagonal).alias(value)))
    return out


# counters
def category_counts(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    return df.groupBy(*[quoted(c) for c in names(keys, df)]).agg(F.count(F.lit(1)).alias("n"))


def marginal_counts(counts: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    return counts.groupBy(*[quoted(c) for c in names(keys, counts)]).agg(F.sum("n").alias("n"))


def cross_tab(counts: DataFrame, row: str, col_name: str) -> DataFrame:
    """All cells, zeros where nothing was counted; labels are few by nature of a table."""
    return counts.groupBy(row).pivot(col_name).agg(F.sum("n")).na.fill(0)


def to_freqs(counts: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    if group:
        return counts.withColumn("freq", F.col("n") / F.sum("n").over(W.partitionBy(*group)))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("__all")))).withColumn("freq", F.col("n") / F.col("__all")).drop("__all")


def counts_entropy(counts: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Shannon entropy in bits of counts, from sums alone: log2(N) - Σ n·log2(n) / N."""
    h = F.log2(F.sum("n")) - F.sum(F.when(F.col("n") > 0, F.col("n") * F.log2("n")).otherwise(0.0)) / F.sum("n")
    return counts.groupBy(*group).agg(h.alias("entropy"))


def expand_counts(counts: DataFrame) -> DataFrame:
    return counts.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("__i", "n")


def mode(counts: DataFrame, key: str, group: Sequence[str] = ()) -> DataFrame:
    """The key with the highest count, of equals the largest key."""
    return counts.groupBy(*group).agg(F.max_by(key, F.struct("n", key)).alias("mode"))


def summary_stats(df: DataFrame, value: str, group: Sequence[str] = (), quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Mean, sample variance and deviation, exact quantiles with linear interpolation."""
    v = quoted(value)
    qs = [F.percentile(v, q).alias(f"q{round(q * 100)}") for q in quantiles]
    return df.groupBy(*group).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.var_samp(v).alias("var"), F.stddev_samp(v).alias("std"), *qs)


def number_counter_stats(counts: DataFrame, key: str) -> DataFrame:
    """Weighted mean and unbiased variance of counted numbers."""
    k, n = F.col(key).cast("double"), F.col("n")
    mean = F.sum(k * n) / F.sum(n)
    var = (F.sum(k * k * n) - F.sum(k * n) * F.sum(k * n) / F.sum(n)) / (F.sum(n) - 1)
    return counts.agg(mean.alias("mean"), var.alias("var"), F.sqrt(var).alias("std"))


# indexing of labelled matrices
def take_labels(long: DataFrame, axis: str, labels: Iterable, negate: bool = False) -> DataFrame:
    c = F.col(axis).isin(*labels)
    return long.filter(~c if negate else c)


# leaving
def to_rich_json(df: DataFrame, title: str = "") -> str:
    return json.dumps({"type": "table", "title": title, "schema": json.loads(df.schema.json()), "rows": [json.loads(r) for r in df.toJSON().collect()]})


def from_rich_json(spark: SparkSession, text: str) -> DataFrame:
    data = json.loads(text)
    schema = T.StructType.fromJson(data["schema"])
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in data["rows"]], schema)


def to_dict(df: DataFrame, index: str) -> dict:
    return {r[index]: {c: r[c] for c in df.columns if c != index} for r in df.collect()}


def format_table(df: DataFrame, style: str = "simple", limit: int = 1000, digits: int = 4, title: str = "") -> str:
    """Up to `limit` rows as text: simple, md, rst, latex, html, csv or tsv. A display form: larger tables are written by Spark."""
    rows = [["" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v) for v in r] for r in df.limit(limit).collect()]
    heads = list(df.columns)
    wide = [max(len(x) for x in column) for column in zip(heads, *rows)] if rows else [len(h) for h in heads]
    line = lambda cells, sep: sep.join(c.rjust(w) for c, w in zip(cells, wide))
    top = [title] if title else []
    if style in ("csv", "tsv"):
        sep = "," if style == "csv" else "\t"
        cell = lambda v: '"' + v.replace('"', '""') + '"' if sep in v or '"' in v or "\n" in v else v
        return "\n".join(top + [sep.join(map(cell, r)) for r in [heads, *rows]])
    if style == "md":
        return "\n".join(top + [f"| {line(heads, ' | ')} |", "|" + "|".join("-" * (w + 2) for w in wide) + "|"] + [f"| {line(r, ' | ')} |" for r in rows])
    if style == "rst":
        rule = lambda c: "+" + "+".join(c * (w + 2) for w in wide) + "+"
        body = [x for r in rows for x in (f"| {line(r, ' | ')} |", rule("-"))]
        return "\n".join(top + [rule("-"), f"| {line(heads, ' | ')} |", rule("=")] + body)
    if style == "latex":
        body = [" & ".join(r) + r" \\" for r in rows]
        return "\n".join([r"\begin{table}", r"\begin{tabular}{" + "r" * len(heads) + "}", r"\hline", " & ".join(heads) + r" \\", r"\hline", *body, r"\hline", r"\end{tabular}", *([rf"\caption{{{title}}}"] if title else []), r"\end{table}"])
    if style == "html":
        cells = lambda r, t: "<tr>" + "".join(f"<{t}>{html.escape(c)}</{t}>" for c in r) + "</tr>"
        return "<table>" + (f"<caption>{html.escape(title)}</caption>" if title else "") + cells(heads, "th") + "".join(cells(r, "td") for r in rows) + "</table>"
    rule = "-" * (sum(wide) + 4 * (len(wide) - 1))
    return "\n".join(top + [line(heads, "    "), rule] + [line(r, "    ") for r in rows] + [rule])


def format_column(df: DataFrame, column: str, template: str | Callable[[Column], Column]) -> DataFrame:
    """The column as text, by a printf template or a function of the column; a column for writing or display."""
    made = template(quoted(column)) if callable(template) else F.format_string(template, quoted(column))
    return df.withColumn(column, made)


def to_csv(df: DataFrame, **options) -> str:
    return format_table(df, "csv", **options)


def to_tsv(df: DataFrame, **options) -> str:
    return format_table(df, "tsv", **options)


def to_markdown(df: DataFrame, **options) -> str:
    return format_table(df, "md", **options)


def to_rst(df: DataFrame, csv_table: bool = False, title: str = "", **options) -> str:
    """A grid, or with `csv_table` a directive with comma separated values."""
    if not csv_table:
        return format_table(df, "rst", title=title, **options)
    head, *rows = format_table(df, "csv", **options).split("\n")
    return "\n".join([f".. csv-table:: {title}".rstrip(), f"    :header: {head}", "", *(f"    {r}" for r in rows)])


def to_latex(df: DataFrame, **options) -> str:
    return format_table(df, "latex", **options)


def to_html(df: DataFrame, **options) -> str:
    return format_table(df, "html", **options)


def write_table(df: DataFrame, path: str, style: str = "tsv", compression: str = "none", header: bool = True) -> None:
    """A table of any size as delimited (csv, tsv), JSON-lines or Parquet files, by Spark's own writers: a folder of parts."""
    out = df.write.mode("overwrite").option("compression", "uncompressed" if style == "parquet" and compression == "none" else compression)
    if style in ("csv", "tsv"):
        out.option("header", header).option("sep", "," if style == "csv" else "\t").csv(path)
    elif style == "json":
        out.json(path)
    elif style == "parquet":
        out.parquet(path)
    else:
        raise ValueError(f"no writer for {style}")


def write_matrix(long: DataFrame, path: str, sep: str = "\t", row: str = "row", col_name: str = "col", value: str = "value") -> None:
    """A long matrix as (row, col, value) lines, by Spark's writer."""
    long.select(row, col_name, value).write.mode("overwrite").option("sep", sep).option("header", True).csv(path)
