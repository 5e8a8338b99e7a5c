"""Registration, table access and SQL fragments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulens.functions.scalars import exact_round

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, its oracle."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Round the named columns for comparison."""
    return df.withColumns({n: exact_round(F.col(n), d) for n, d in digits.items()})


def sql_round(expression: str, digits: int) -> str:
    """The same rounding in DuckDB."""
    return f"CAST(format('{{:.{digits}f}}', CAST({expression} AS DOUBLE)) AS DOUBLE)"


def sql_iso(expression: str) -> str:
    """ISO text of a timestamp; microseconds only when there are any."""
    return (
        f"CASE WHEN {expression} IS NULL THEN NULL "
        f"WHEN extract(microsecond FROM {expression}) % 1000000 = 0 "
        f"THEN strftime({expression}, '%Y-%m-%dT%H:%M:%S') "
        f"ELSE strftime({expression}, '%Y-%m-%dT%H:%M:%S.%f') END"
    )


# Orders with gaps: the test tables have none, so some values are blanked out.
GAPPY_ORDERS = """
    SELECT o_orderkey,
           CASE WHEN o_totalprice >= 60000 THEN o_totalprice END AS price,
           NULLIF(o_orderstatus, 'P') AS status,
           NULLIF(o_orderpriority, '5-LOW') AS priority,
           o_orderdate
    FROM orders
"""


def gappy_orders(spark: SparkSession, folder: str) -> DataFrame:
    def blank(name: str, keep: Column) -> Column:
        return F.when(keep, F.col(name))

    return table(spark, folder, "orders").select(
        "o_orderkey",
        blank("o_totalprice", F.col("o_totalprice") >= 60000).alias("price"),
        blank("o_orderstatus", F.col("o_orderstatus") != "P").alias("status"),
        blank("o_orderpriority", F.col("o_orderpriority") != "5-LOW").alias("priority"),
        "o_orderdate",
    )


# The same after cleaning.
CLEAN_ORDERS = f"""
    SELECT o_orderkey,
           COALESCE(price, (SELECT AVG(price) FROM ({GAPPY_ORDERS}))) AS price,
           status, priority, o_orderdate
    FROM ({GAPPY_ORDERS})
    WHERE status IS NOT NULL AND priority IS NOT NULL
"""
