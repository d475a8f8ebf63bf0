"""Queries over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "table_group_aggregate"


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@register("table_group_aggregate", "SELECT l_returnflag, l_linestatus, count(*) AS n, min(l_quantity) AS min_qty, max(l_extendedprice) AS max_price FROM lineitem GROUP BY ALL")
def table_group_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from ..session import table

    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.min("l_quantity").alias("min_qty"), F.max("l_extendedprice").alias("max_price"))


from . import alignment_queries, interval_queries, more_queries, sequence_queries, stat_queries, table_queries, wide_queries, form_queries, model_queries  # noqa: E402, F401
