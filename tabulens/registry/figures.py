"""Chart and insight queries."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.functions.scalars import exact_round
from tabulens.operators import charts as C
from tabulens.operators import insights as I
from tabulens.plans.report import analyze, auto_charts, auto_report, basic_insights, describe
from tabulens.plans.suggest import suggest_instructions
from tabulens.operators.types import detect_types
from tabulens.registry.base import query, rounded, sql_iso, sql_round, table

# Unique order of lineitem rows.
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
_LINE_ORDER = ", ".join(LINE_ORDER)


@query(
    "bar_price_by_flag",
    f"""SELECT label, {sql_round('y', 4)} AS y FROM (
        SELECT l_returnflag AS label, AVG(l_extendedprice) AS y FROM lineitem
        WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY 2 DESC NULLS LAST, 1 LIMIT 15)""",
)
def bar_price_by_flag(spark, folder):
    return rounded(C.bar_chart(table(spark, folder, "lineitem"), "l_returnflag", "l_extendedprice"), y=4)


@query(
    "line_price_by_orderdate",
    f"""SELECT {sql_iso('o_orderdate')} AS label, {sql_round('y', 6)} AS y FROM (
        SELECT o_orderdate, AVG(o_totalprice) AS y FROM orders
        WHERE o_orderdate IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 50)""",
)
def line_price_by_orderdate(spark, folder):
    return rounded(C.line_chart(table(spark, folder, "orders"), "o_orderdate", "o_totalprice"), y=6)


def _xy_sql(source: str, x: str, value: str, digits: int) -> str:
    return f"""SELECT label, {sql_round('y', digits)} AS y FROM (
        SELECT CAST({x} AS VARCHAR) AS label, {value} AS y, {x} AS k FROM {source}
        WHERE {x} IS NOT NULL GROUP BY {x} ORDER BY {x} LIMIT 50)"""


@query(
    "xy_sum_by_segment", _xy_sql("customer", "c_mktsegment", "COALESCE(SUM(c_acctbal), 0)", 2)
)
def xy_sum_by_segment(spark, folder):
    return rounded(C.xy_chart(table(spark, folder, "customer"), "c_mktsegment", "c_acctbal", "sum"), y=2)


@query("xy_mean_by_type", _xy_sql("part", "p_type", "AVG(p_retailprice)", 6))
def xy_mean_by_type(spark, folder):
    return rounded(C.xy_chart(table(spark, folder, "part"), "p_type", "p_retailprice", "mean"), y=6)


@query("xy_count_by_event", _xy_sql("events", "event_type", "COUNT(value)", 2))
def xy_count_by_event(spark, folder):
    return rounded(C.xy_chart(table(spark, folder, "events"), "event_type", "value", "count"), y=2)


@query("xy_sum_by_quantity", _xy_sql("lineitem", "l_quantity", "SUM(l_extendedprice)", 2))
def xy_sum_by_quantity(spark, folder):
    """Floating-point key."""
    return rounded(C.xy_chart(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice"), y=2)


@query(
    "pie_sum_by_status",
    f"""SELECT o_orderstatus AS label, {sql_round('COALESCE(SUM(o_totalprice), 0)', 2)} AS y
        FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1""",
)
def pie_sum_by_status(spark, folder):
    return rounded(C.pie_chart(table(spark, folder, "orders"), "o_orderstatus", "o_totalprice"), y=2)


@query(
    "pie_counts_priority",
    """SELECT o_orderpriority AS label, CAST(COUNT(*) AS DOUBLE) AS y FROM orders
        WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
def pie_counts_priority(spark, folder):
    return C.pie_chart(table(spark, folder, "orders"), "o_orderpriority")


@query(
    "pie_counts_source",
    """SELECT source AS label, CAST(COUNT(*) AS DOUBLE) AS y FROM documents
        WHERE source IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
def pie_counts_source(spark, folder):
    """More keys than slices, many of them tied."""
    return C.pie_chart(table(spark, folder, "documents"), "source")


def _histogram_sql(column: str, source: str = "lineitem") -> str:
    return f"""WITH v AS (SELECT CAST({column} AS DOUBLE) AS v FROM {source} WHERE {column} IS NOT NULL),
        span AS (SELECT MIN(v) AS lo, MAX(v) AS hi FROM v),
        bins AS (SELECT CAST(i AS INTEGER) AS bin, i * ((hi - lo) / 10) + lo AS low,
                        CASE WHEN i = 9 THEN hi ELSE (i + 1) * ((hi - lo) / 10) + lo END AS high
                 FROM span, range(10) AS r(i))
        SELECT bin, format('{{:.1f}}–{{:.1f}}', low, high) AS label,
               CAST((SELECT COUNT(*) FROM v WHERE v.v >= bins.low
                     AND (v.v < bins.high OR (bin = 9 AND v.v <= bins.high))) AS DOUBLE) AS y
        FROM bins"""


@query("hist_price", _histogram_sql("l_extendedprice"))
def hist_price(spark, folder):
    return C.histogram(table(spark, folder, "lineitem"), "l_extendedprice").select("bin", "label", "y")


@query("hist_discount", _histogram_sql("l_discount"))
def hist_discount(spark, folder):
    """Values that sit on the bin edges."""
    return C.histogram(table(spark, folder, "lineitem"), "l_discount").select("bin", "label", "y")


@query("hist_document_size", _histogram_sql("n_chars", "documents"))
def hist_document_size(spark, folder):
    """Long tail, so most bins are nearly empty."""
    return C.histogram(table(spark, folder, "documents"), "n_chars").select("bin", "label", "y")


@query(
    "scatter_qty_price",
    f"""SELECT x, y FROM (SELECT l_quantity AS x, l_extendedprice AS y, {_LINE_ORDER} FROM lineitem
        WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL
        ORDER BY {_LINE_ORDER} LIMIT 200)""",
)
def scatter_qty_price(spark, folder):
    lines = table(spark, folder, "lineitem")
    return C.scatter_points(lines, "l_quantity", "l_extendedprice", F.struct(*LINE_ORDER))


@query(
    "scatter_corr_200",
    f"""SELECT {sql_round('corr(x, y)', 2)} AS correlation FROM (
        SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem ORDER BY {_LINE_ORDER} LIMIT 200)""",
)
def scatter_corr_200(spark, folder):
    return rounded(C.points_correlation(scatter_qty_price(spark, folder)), correlation=2)


# One instruction per chart type and aggregation, and some that do not fit.
CHART_REQUESTS = [
    {"id": "line", "type": "line", "x": "o_orderdate", "y": "o_totalprice", "aggregation": "count"},
    {"id": "bar", "type": "bar", "x": "o_orderpriority", "y": "o_totalprice"},
    {"id": "none", "type": "bar", "x": "o_orderstatus", "y": "o_totalprice", "aggregation": "none"},
    {"id": "pie", "type": "pie", "x": "o_orderstatus", "y": "o_totalprice", "aggregation": "mean"},
    {"id": "slices", "type": "pie", "x": "o_orderpriority"},
    {"id": "radar", "type": "radar", "x": "o_orderpriority", "y": "o_custkey", "aggregation": "mean"},
    {"id": "no_column", "type": "bar", "x": "o_orderstatus", "y": "missing"},
    {"id": "text_sum", "type": "bar", "x": "o_orderstatus", "y": "o_orderpriority"},
    {"id": "same", "type": "bar", "x": "o_custkey", "y": "o_custkey"},
    {"id": "no_y", "type": "line", "x": "o_orderdate"},
]


def _chart_sql(chart: str, x: str, y: str, tail: str) -> str:
    return f"""SELECT '{chart}' AS chart_id, label, {sql_round('y', 2)} AS y FROM (
        SELECT {x} AS label, {y} AS y FROM orders GROUP BY {x} {tail})"""


@query(
    "chart_batch",
    " UNION ALL ".join(
        [
            _chart_sql(
                "line", "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')", "COUNT(o_totalprice)", "ORDER BY 1 LIMIT 50"
            ),
            _chart_sql("bar", "o_orderpriority", "SUM(o_totalprice)", "ORDER BY 1 LIMIT 50"),
            _chart_sql("none", "o_orderstatus", "SUM(o_totalprice)", "ORDER BY 1 LIMIT 50"),
            _chart_sql("pie", "o_orderstatus", "SUM(o_totalprice)", ""),
            _chart_sql("slices", "o_orderpriority", "COUNT(*)", "ORDER BY 2 DESC, 1 LIMIT 10"),
            _chart_sql("radar", "o_orderpriority", "AVG(o_custkey)", "ORDER BY 1 LIMIT 50"),
        ]
    ),
)
def chart_batch(spark, folder):
    charts, _ = C.build_charts(table(spark, folder, "orders"), CHART_REQUESTS, F.col("o_orderkey"))
    return rounded(C.charts_frame(charts).select("chart_id", "label", "y"), y=2)


@query(
    "trend_price_by_shipdate",
    f"""WITH g AS (SELECT l_shipdate AS x, SUM(l_extendedprice) AS t FROM lineitem
                   WHERE l_shipdate IS NOT NULL GROUP BY 1),
        e AS (SELECT COUNT(*) AS n, arg_min(t, x) AS a, arg_max(t, x) AS b FROM g),
        c AS (SELECT n, a, b, CASE WHEN a = 0 THEN 0.0 ELSE {sql_round('(b - a) / a * 100', 1)} END AS c FROM e)
        SELECT n AS groups, {sql_round('a', 2)} AS first_total, {sql_round('b', 2)} AS last_total,
               c AS change_percent, CASE WHEN c > 0 THEN 'increased' ELSE 'decreased' END AS direction
        FROM c WHERE n >= 2""",
)
def trend_price_by_shipdate(spark, folder):
    found = I.trend(table(spark, folder, "lineitem"), "l_shipdate", "l_extendedprice")
    return rounded(found, first_total=2, last_total=2)


@query(
    "top5_price_by_brand",
    f"""SELECT p_brand AS label, {sql_round('SUM(p_retailprice)', 2)} AS y FROM part
        WHERE p_brand IS NOT NULL GROUP BY 1 ORDER BY SUM(p_retailprice) DESC, 1 LIMIT 5""",
)
def top5_price_by_brand(spark, folder):
    return rounded(I.top_groups(table(spark, folder, "part"), "p_brand", "p_retailprice"), y=2)


def _corr_sql(source: str, x: str, y: str) -> str:
    return f"""SELECT c AS correlation,
        CASE WHEN ABS(c) > 0.7 THEN 'strong' WHEN ABS(c) > 0.4 THEN 'moderate' ELSE 'weak' END AS strength,
        CASE WHEN c > 0 THEN 'positive' ELSE 'negative' END AS direction
        FROM (SELECT {sql_round(f'corr({x}, {y})', 3)} AS c FROM {source})"""


@query("corr_size_price", _corr_sql("part", "p_size", "p_retailprice"))
def corr_size_price(spark, folder):
    return I.correlation(table(spark, folder, "part"), "p_size", "p_retailprice")


@query("corr_part_price", _corr_sql("part", "p_partkey", "p_retailprice"))
def corr_part_price(spark, folder):
    return I.correlation(table(spark, folder, "part"), "p_partkey", "p_retailprice")


ANALYSIS_REQUESTS = [
    {"id": "a", "type": "trend", "description": "trend", "columns": ["o_orderdate", "o_totalprice"]},
    {"id": "b", "type": "groupby", "description": "top", "columns": ["gone", "o_orderpriority", "o_totalprice"]},
    {"id": "c", "type": "correlation", "description": "corr", "columns": ["o_custkey", "o_totalprice"]},
    {"id": "d", "type": "distribution", "description": "nothing", "columns": ["o_custkey", "o_totalprice"]},
    {"id": "e", "type": "groupby", "description": "text", "columns": ["o_orderstatus", "o_orderpriority"]},
]


def _findings(found, digits: int = 2) -> DataFrame:
    return rounded(found.select("position", "type", "column", "key", "number", "text"), number=digits)


@query(
    "insight_batch",
    f"""WITH g AS (SELECT o_orderdate AS x, SUM(o_totalprice) AS t FROM orders GROUP BY 1),
        e AS (SELECT arg_min(t, x) AS a, arg_max(t, x) AS b FROM g),
        c AS (SELECT CASE WHEN a = 0 THEN 0.0 ELSE {sql_round('(b - a) / a * 100', 1)} END AS c FROM e),
        r AS (SELECT {sql_round('corr(o_custkey, o_totalprice)', 3)} AS r FROM orders),
        t AS (SELECT o_orderpriority AS k, SUM(o_totalprice) AS s FROM orders GROUP BY 1
              ORDER BY 2 DESC, 1 LIMIT 5)
        SELECT 1 AS position, 'trend' AS type, CAST(NULL AS VARCHAR) AS "column", 'change_percent' AS key,
               c AS number, CAST(NULL AS VARCHAR) AS text FROM c
        UNION ALL SELECT 1, 'trend', NULL, 'direction', NULL,
               CASE WHEN c > 0 THEN 'increased' ELSE 'decreased' END FROM c
        UNION ALL SELECT 2, 'groupby', NULL, k, {sql_round('s', 2)}, NULL FROM t
        UNION ALL SELECT 3, 'correlation', NULL, 'correlation', {sql_round('r', 2)}, NULL FROM r
        UNION ALL SELECT 3, 'correlation', NULL, 'strength', NULL,
               CASE WHEN ABS(r) > 0.7 THEN 'strong' WHEN ABS(r) > 0.4 THEN 'moderate' ELSE 'weak' END FROM r
        UNION ALL SELECT 3, 'correlation', NULL, 'direction', NULL,
               CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END FROM r""",
)
def insight_batch(spark, folder):
    found, _ = I.run_analyses(table(spark, folder, "orders"), ANALYSIS_REQUESTS)
    return _findings(I.insights_frame(spark, found))


# Best number by variation, then the next one, among the columns not named like identifiers.
_LINE_CHOICES = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_RANKED = "SELECT c, v FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS c, {i} AS p, STDDEV_SAMP({c}) / AVG({c}) AS v FROM lineitem" for i, c in enumerate(_LINE_CHOICES)
) + ") ORDER BY v DESC, p"


def _choice_sql(source: str) -> str:
    """The value of the column that a one-row table names."""
    cases = " ".join(f"WHEN '{c}' THEN {c}" for c in _LINE_CHOICES)
    return f"CASE (SELECT c FROM {source}) {cases} END"


def _stat_sql(position: int, rank: int, names: list[str]) -> str:
    """Summary rows of the column at the given rank."""
    columns = _LINE_CHOICES
    stat = {
        "mean": "AVG",
        "median": "MEDIAN",
        "min": "MIN",
        "max": "MAX",
        "sum": "SUM",
    }
    parts = []
    for name in names:
        choice = " ".join(f"WHEN '{c}' THEN {stat[name]}({c})" for c in columns)
        parts.append(
            f"SELECT {position} AS position, 'stats' AS type, (SELECT c FROM ranked LIMIT 1 OFFSET {rank}) "
            f"AS \"column\", '{name}' AS key, {sql_round(f'CASE (SELECT c FROM ranked LIMIT 1 OFFSET {rank}) {choice} END', 2)} "
            "AS number, CAST(NULL AS VARCHAR) AS text FROM lineitem"
        )
    return " UNION ALL ".join(parts)


def _top_facts_sql(position: int, column: str, source: str) -> str:
    """Facts about the values of a category: the most frequent one, its share, how many there are."""
    counts = f"SELECT {column} AS v, COUNT(*) AS n FROM {source} WHERE {column} IS NOT NULL GROUP BY 1"
    first = f"FROM ({counts}) ORDER BY n DESC, v LIMIT 1"
    parts = (
        ("value", "CAST(NULL AS DOUBLE)", f"(SELECT v {first})"),
        ("pct", sql_round(f"(SELECT n {first}) * 100.0 / (SELECT SUM(n) FROM ({counts}))", 1), "NULL"),
        ("unique_count", f"CAST((SELECT COUNT(*) FROM ({counts})) AS DOUBLE)", "NULL"),
    )
    return " UNION ALL ".join(
        f"SELECT {position}, 'top_values_facts', '{column}', '{key}', {number}, {text}" for key, number, text in parts
    )


_BASIC_INSIGHTS = f"""WITH ranked AS ({_RANKED})
    {_stat_sql(1, 0, ["mean", "median", "min", "max", "sum"])}
    UNION ALL SELECT * FROM (
        SELECT 2, 'top_values', 'l_returnflag', l_returnflag, CAST(COUNT(*) AS DOUBLE), NULL
        FROM lineitem GROUP BY l_returnflag ORDER BY 5 DESC, 4 LIMIT 6)
    UNION ALL {_top_facts_sql(2, "l_returnflag", "lineitem")}
    UNION ALL {_stat_sql(3, 1, ["mean", "min", "max"])}"""


@query("auto_insights", _BASIC_INSIGHTS)
def auto_insights(spark, folder):
    found = basic_insights(describe(table(spark, folder, "lineitem")))
    return _findings(I.insights_frame(spark, found))


@query(
    "auto_charts",
    f"""WITH ranked AS ({_RANKED}), one AS (SELECT c FROM ranked LIMIT 1), two AS (SELECT c FROM ranked LIMIT 1 OFFSET 1),
        l AS (SELECT *,
            {_choice_sql("one")} AS a, {_choice_sql("two")} AS b
            FROM lineitem),
        span AS (SELECT MIN(a) AS lo, MAX(a) AS hi FROM l),
        bins AS (SELECT i, i * ((hi - lo) / 10) + lo AS low,
                 CASE WHEN i = 9 THEN hi ELSE (i + 1) * ((hi - lo) / 10) + lo END AS high FROM span, range(10) AS r(i))
        SELECT 'auto_1' AS chart_id, label, CAST(NULL AS DOUBLE) AS x, {sql_round('y', 6)} AS y FROM (
            SELECT strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS label, AVG(a) AS y
            FROM l GROUP BY 1 ORDER BY 1 LIMIT 50)
        UNION ALL SELECT 'auto_2', label, NULL, {sql_round('y', 6)} FROM (
            SELECT l_returnflag AS label, AVG(a) AS y FROM l GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15)
        UNION ALL SELECT 'auto_3', format('{{:.1f}}–{{:.1f}}', low, high), NULL, CAST((SELECT COUNT(*) FROM l
            WHERE a >= low AND (a < high OR (i = 9 AND a <= high))) AS DOUBLE) FROM bins
        UNION ALL SELECT 'auto_4', NULL, x, y FROM (
            SELECT CAST(a AS DOUBLE) AS x, CAST(b AS DOUBLE) AS y FROM l ORDER BY {_LINE_ORDER} LIMIT 200)""",
)
def auto_charts_rows(spark, folder):
    lines = table(spark, folder, "lineitem")
    found = auto_charts(lines, describe(lines), F.struct(*LINE_ORDER))
    points = C.charts_frame(found).select("chart_id", "label", "x", "y")
    return points.withColumn(
        "y", F.when(F.col("chart_id").isin("auto_1", "auto_2"), exact_round(F.col("y"), 6)).otherwise(F.col("y"))
    )


UNFIT_REQUESTS = {
    "charts": [
        {"id": "gone", "type": "bar", "x": "nowhere", "y": "value"},
        {"id": "unfit", "type": "line", "x": "ts", "y": "event_type", "aggregation": "mean"},
    ],
    "analyses": [{"id": "a", "type": "trend", "description": "trend", "columns": ["ts", "value"]}],
}


@query(
    "topped_up_insights",
    f"""WITH g AS (SELECT ts AS x, SUM(value) AS t FROM events GROUP BY 1),
        e AS (SELECT arg_min(t, x) AS a, arg_max(t, x) AS b FROM g),
        c AS (SELECT CASE WHEN a = 0 THEN 0.0 ELSE {sql_round('(b - a) / a * 100', 1)} END AS c FROM e),
        s AS (SELECT AVG(value) AS mean, MEDIAN(value) AS median, MIN(value) AS min, MAX(value) AS max, SUM(value) AS sum
              FROM events),
        i AS (SELECT AVG(event_id) AS mean, CAST(MIN(event_id) AS DOUBLE) AS min, CAST(MAX(event_id) AS DOUBLE) AS max
              FROM events)
        SELECT 1 AS position, 'trend' AS type, CAST(NULL AS VARCHAR) AS "column", 'change_percent' AS key,
               c AS number, CAST(NULL AS VARCHAR) AS text FROM c
        UNION ALL SELECT 1, 'trend', NULL, 'direction', NULL,
               CASE WHEN c > 0 THEN 'increased' ELSE 'decreased' END FROM c
        UNION ALL SELECT 2, 'stats', 'value', name, {sql_round('number', 2)}, NULL
               FROM (UNPIVOT s ON mean, median, min, max, sum INTO NAME name VALUE number)
        UNION ALL SELECT * FROM (
            SELECT 3, 'top_values', 'event_type', event_type, CAST(COUNT(*) AS DOUBLE), NULL
            FROM events GROUP BY event_type ORDER BY 5 DESC, 4 LIMIT 6)
        UNION ALL {_top_facts_sql(3, "event_type", "events")}
        UNION ALL SELECT 4, 'stats', 'event_id', name, {sql_round('number', 2)}, NULL
               FROM (UNPIVOT i ON mean, min, max INTO NAME name VALUE number)""",
)
def topped_up_insights(spark, folder):
    """One finding is too few, so the column summaries follow."""
    report = analyze(table(spark, folder, "events"), UNFIT_REQUESTS, order_by=["event_id"])
    return _findings(report.table("insights"))


@query(
    "fallback_charts",
    f"""WITH span AS (SELECT MIN(value) AS lo, MAX(value) AS hi FROM events),
        bins AS (SELECT i, i * ((hi - lo) / 10) + lo AS low,
                 CASE WHEN i = 9 THEN hi ELSE (i + 1) * ((hi - lo) / 10) + lo END AS high FROM span, range(10) AS r(i))
        SELECT 'auto_1' AS chart_id, label, CAST(NULL AS DOUBLE) AS x, {sql_round('y', 6)} AS y FROM (
            SELECT {sql_iso('ts')} AS label, AVG(value) AS y, ts FROM events GROUP BY ts ORDER BY ts LIMIT 50)
        UNION ALL SELECT 'auto_2', label, NULL, {sql_round('y', 6)} FROM (
            SELECT event_type AS label, AVG(value) AS y FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15)
        UNION ALL SELECT 'auto_3', format('{{:.1f}}–{{:.1f}}', low, high), NULL, CAST((SELECT COUNT(*) FROM events
            WHERE value >= low AND (value < high OR (i = 9 AND value <= high))) AS DOUBLE) FROM bins
        UNION ALL SELECT 'auto_4', NULL, value, CAST(event_id AS DOUBLE) FROM (
            SELECT value, event_id FROM events ORDER BY event_id LIMIT 200)""",
)
def fallback_charts(spark, folder):
    """No requested chart fits, so the charts are chosen by rule."""
    report = analyze(table(spark, folder, "events"), UNFIT_REQUESTS, order_by=["event_id"])
    points = report.table("charts").select("chart_id", "label", "x", "y")
    return points.withColumn(
        "y", F.when(F.col("chart_id").isin("auto_1", "auto_2"), exact_round(F.col("y"), 6)).otherwise(F.col("y"))
    )


_UNEVEN = """SELECT event_id, ts, event_type, CASE WHEN event_id % 7 > 0 THEN value END AS score,
    CASE WHEN event_id % 501 = 0 THEN CAST('infinity' AS DOUBLE) WHEN event_id % 503 = 0 THEN CAST('-infinity' AS DOUBLE)
         ELSE value END AS drift FROM events"""


def _figure_sql(column: str, key: str, number: str, text: str = "NULL") -> str:
    return f"""SELECT '{column}' AS part, '{key}' AS key, {sql_round(number, 4)} AS number,
        CAST({text} AS VARCHAR) AS text FROM s"""


@query(
    "auto_report_infinite",
    f"""WITH s AS ({_UNEVEN}), span AS (SELECT MIN(score) AS lo, MAX(score) AS hi FROM s),
        bins AS (SELECT i, i * ((hi - lo) / 10) + lo AS low,
                 CASE WHEN i = 9 THEN hi ELSE (i + 1) * ((hi - lo) / 10) + lo END AS high FROM span, range(10) AS r(i))
        {_figure_sql("score", "count", "COUNT(score)")}
        UNION ALL {_figure_sql("score", "null_count", "COUNT(*) - COUNT(score)")}
        UNION ALL {_figure_sql("score", "mean", "AVG(score)")}
        UNION ALL {_figure_sql("score", "median", "MEDIAN(score)")}
        UNION ALL {_figure_sql("score", "std", "STDDEV_SAMP(score)")}
        UNION ALL {_figure_sql("score", "min", "MIN(score)")}
        UNION ALL {_figure_sql("score", "max", "MAX(score)")}
        UNION ALL {_figure_sql("drift", "count", "COUNT(drift)")}
        UNION ALL {_figure_sql("drift", "null_count", "COUNT(*) - COUNT(drift)")}
        UNION ALL {_figure_sql("drift", "median", "MEDIAN(drift)")}
        UNION ALL {_figure_sql("drift", "min", "NULL", "CASE WHEN isinf(MIN(drift)) AND MIN(drift) < 0 THEN '-inf' END")}
        UNION ALL {_figure_sql("drift", "max", "NULL", "CASE WHEN isinf(MAX(drift)) AND MAX(drift) > 0 THEN 'inf' END")}
        UNION ALL {_figure_sql("stats score", "sum", "SUM(score)")}
        UNION ALL {_figure_sql("stats event_id", "mean", "AVG(event_id)")}
        UNION ALL SELECT * FROM (SELECT 'auto_2', event_type, {sql_round('AVG(score)', 4)}, NULL FROM s GROUP BY event_type
            ORDER BY AVG(score) DESC, 2 LIMIT 15)
        UNION ALL SELECT 'auto_3', format('{{:.1f}}–{{:.1f}}', low, high), CAST((SELECT COUNT(*) FROM s
            WHERE score >= low AND (score < high OR (i = 9 AND score <= high))) AS DOUBLE), NULL FROM bins""",
)
def auto_report_infinite(spark, folder):
    """A column with NaN and one with infinities: NaN is missing, and what infinities leave undefined is not chosen."""
    value, number = F.col("value"), F.col("event_id")
    uneven = table(spark, folder, "events").select(
        "event_id",
        "ts",
        "event_type",
        F.when(number % 7 > 0, value).otherwise(float("nan")).alias("score"),
        F.when(number % 501 == 0, float("inf")).when(number % 503 == 0, float("-inf")).otherwise(value).alias("drift"),
    )
    report = auto_report(uneven, order_by=["event_id"])
    shown = {"score": ("count", "null_count", "mean", "median", "std", "min", "max"), "drift": ("count", "null_count", "median", "min", "max")}
    found: list[tuple] = []
    for row in report.described.rows:
        for key in shown.get(row["column"], ()):
            figure = float(row[key])
            found.append((row["column"], key, figure, None) if math.isfinite(figure) else (row["column"], key, None, str(figure)))
    for insight, key in ((report.insights[0], "sum"), (report.insights[2], "mean")):
        found.append((f"{insight.type} {insight.column}", key, float(insight.data[key]), None))
    figures = spark.createDataFrame(found, "part string, key string, number double, text string")
    points = report.table("charts").where(F.col("chart_id").isin("auto_2", "auto_3"))
    points = points.select(F.col("chart_id").alias("part"), F.col("label").alias("key"), F.col("y").alias("number"), F.lit(None).cast("string").alias("text"))
    return rounded(figures.unionAll(points), number=4)


@query(
    "suggested_instructions",
    """SELECT 'line' AS type, 'o_orderdate' AS x, 'o_orderkey' AS y, 'sum' AS aggregation
       WHERE (SELECT COUNT(o_orderdate) FROM orders) > 0
       UNION ALL SELECT 'bar', 'o_orderstatus', 'o_orderkey', 'sum'
       WHERE (SELECT COUNT(DISTINCT o_orderstatus) * 1.0 / COUNT(*) FROM orders) < 0.2
       UNION ALL SELECT 'scatter', 'o_orderkey', 'o_custkey', 'none'""",
)
def suggested_instructions(spark, folder):
    wanted = suggest_instructions(detect_types(table(spark, folder, "orders")))
    return spark.createDataFrame(
        [(c["type"], c["x"], c["y"], c["aggregation"]) for c in wanted["charts"]],
        "type string, x string, y string, aggregation string",
    )


@query(
    "suggested_report",
    f"""WITH g AS (SELECT o_orderdate AS x, SUM(o_orderkey) AS t FROM orders GROUP BY 1),
        e AS (SELECT arg_min(t, x) AS a, arg_max(t, x) AS b FROM g)
        SELECT 'chart_1' AS part, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS label,
               CAST(SUM(o_orderkey) AS DOUBLE) AS value FROM orders GROUP BY o_orderdate
               QUALIFY ROW_NUMBER() OVER (ORDER BY o_orderdate) <= 50
        UNION ALL SELECT 'chart_2', o_orderstatus, CAST(SUM(o_orderkey) AS DOUBLE) FROM orders GROUP BY 2
        UNION ALL SELECT 'chart_3', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS DOUBLE) FROM (
            SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 200)
        UNION ALL SELECT 'trend', 'change_percent', {sql_round('(b - a) / a * 100', 1)} FROM e
        UNION ALL SELECT 'groupby', o_orderstatus, CAST(SUM(o_orderkey) AS DOUBLE) FROM orders GROUP BY 2""",
)
def suggested_report(spark, folder):
    """The whole analysis without instructions: charts and findings in one table."""
    report = analyze(table(spark, folder, "orders"), order_by=["o_orderkey"])
    points = [
        C.charts_frame([c]).select(
            F.lit(c.chart_id).alias("part"),
            F.coalesce("label", F.col("x").cast("bigint").cast("string")).alias("label"),
            F.col("y").alias("value"),
        )
        for c in report.charts
    ]
    findings = report.table("insights").where(F.col("number").isNotNull())
    points.append(findings.select(F.col("type").alias("part"), F.col("key").alias("label"), F.col("number").alias("value")))
    return reduce(DataFrame.unionAll, points)
