"""Cleaning and validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulens.operators.clean import clean_table, cleaning_report
from tabulens.operators.validate import validate_table
from tabulens.registry.base import (
    CLEAN_ORDERS,
    GAPPY_ORDERS,
    gappy_orders,
    query,
    rounded,
    sql_round,
    table,
)


@query(
    "clean_orders",
    f"SELECT o_orderkey, {sql_round('price', 2)} AS price, status, priority, o_orderdate FROM ({CLEAN_ORDERS})",
)
def clean_orders(spark, folder):
    frame = clean_table(gappy_orders(spark, folder)).frame
    return frame.withColumn("price", F.round("price", 2))


@query(
    "clean_report",
    f"""WITH g AS ({GAPPY_ORDERS})
        SELECT 'price' AS "column", 'filled' AS action, COUNT(*) - COUNT(price) AS count,
               {sql_round('AVG(price)', 4)} AS fill_value FROM g
        UNION ALL SELECT 'status', 'rows_dropped', COUNT(*) FILTER (WHERE status IS NULL), NULL FROM g
        UNION ALL SELECT 'priority', 'rows_dropped',
               COUNT(*) FILTER (WHERE status IS NOT NULL AND priority IS NULL), NULL FROM g
        UNION ALL SELECT NULL, 'rows_before', COUNT(*), NULL FROM g
        UNION ALL SELECT NULL, 'rows_after',
               COUNT(*) FILTER (WHERE status IS NOT NULL AND priority IS NOT NULL), NULL FROM g""",
)
def clean_report(spark, folder):
    return rounded(cleaning_report(gappy_orders(spark, folder)), fill_value=4)


@query(
    "validate_orders",
    f"""SELECT 'missing_cells' AS "check",
        CASE WHEN pct > 0.05 THEN 'error' ELSE 'warning' END AS severity, pct AS metric
        FROM (SELECT {sql_round('(5 * COUNT(*) - COUNT(o_orderkey) - COUNT(price) - COUNT(status) - COUNT(priority) - COUNT(o_orderdate)) * 1.0 / (5 * COUNT(*))', 4)} AS pct
              FROM ({GAPPY_ORDERS})) WHERE pct > 0.02""",
)
def validate_orders(spark, folder):
    found = validate_table(gappy_orders(spark, folder), order_by=["o_orderkey"])
    return found.checks_frame(spark).drop("detail")


@query(
    "validate_summary",
    f"""SELECT pct <= 0.05 AS valid, n AS row_count, 5 AS column_count, pct AS missing_pct
        FROM (SELECT COUNT(*) AS n, {sql_round('(5 * COUNT(*) - COUNT(o_orderkey) - COUNT(price) - COUNT(status) - COUNT(priority) - COUNT(o_orderdate)) * 1.0 / (5 * COUNT(*))', 4)} AS pct
              FROM ({GAPPY_ORDERS}))""",
)
def validate_summary(spark, folder):
    found = validate_table(gappy_orders(spark, folder), order_by=["o_orderkey"])
    return found.summary_frame(spark).withColumn("column_count", F.col("column_count").cast("int"))


@query(
    "validate_empty",
    """SELECT 'empty_table' AS "check", 'error' AS severity, CAST(0 AS DOUBLE) AS metric
       WHERE (SELECT COUNT(*) FROM orders WHERE o_totalprice < 0) = 0""",
)
def validate_empty(spark, folder):
    """No order has a negative price, so nothing is left to check."""
    none = table(spark, folder, "orders").where("o_totalprice < 0")
    return validate_table(none, order_by=["o_orderkey"]).checks_frame(spark).drop("detail")


_STACKED = """SELECT ROW_NUMBER() OVER (ORDER BY o_orderdate, o_orderkey) AS place, status, price FROM (
    SELECT o_orderdate, o_orderkey, NULLIF(o_orderstatus, 'P') AS status,
           CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price FROM orders)"""


@query(
    "validate_stacked",
    f"""WITH s AS ({_STACKED}), f AS (SELECT MIN(place) AS first FROM s WHERE status IS NULL AND price IS NULL),
        a AS (SELECT COUNT(*) AS n FROM s, f WHERE place > first AND NOT (status IS NULL AND price IS NULL)),
        m AS (SELECT {sql_round('(3 * COUNT(*) - COUNT(status) - COUNT(price)) * 1.0 / (3 * COUNT(*))', 4)} AS pct FROM s)
        SELECT 'stacked_tables' AS "check", 'error' AS severity, CAST(n AS DOUBLE) AS metric FROM a WHERE n > 1
        UNION ALL SELECT 'side_by_side_tables', 'error', 1.0 FROM s HAVING COUNT(price) > 0
        UNION ALL SELECT 'missing_cells', 'error', pct FROM m WHERE pct > 0.05""",
)
def validate_stacked(spark, folder):
    """Empty rows between filled ones, and an empty column between filled ones."""
    orders = table(spark, folder, "orders")
    filled = F.col("o_orderstatus") != "P"
    broken = orders.select(
        F.struct("o_orderdate", "o_orderkey").alias("__position"),
        F.when(filled, F.col("o_orderstatus")).alias("status"),
        F.lit(None).cast("double").alias("nothing"),
        F.when(filled, F.col("o_totalprice")).alias("price"),
    )
    return validate_table(broken).checks_frame(spark).drop("detail")
