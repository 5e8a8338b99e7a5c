"""Type, profile, sample and column-choice queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens.functions import scalars as S
from tabulens.functions.columns import field_type
from tabulens.operators.choose import best_categorical as choose_categorical
from tabulens.operators.choose import best_numeric as choose_numeric
from tabulens.operators.frequency import value_counts
from tabulens.operators.profile import (
    date_profile,
    describe_dataset,
    numeric_profile,
    round_stats,
    sample_rows,
    sample_stats,
    text_date_profile,
    text_profile,
)
from tabulens.operators.quantiles import exact_quantiles
from tabulens.operators.types import detect_types, types_frame
from tabulens.plans.ingest import ingest
from tabulens.plans.report import describe
from tabulens.registry.base import (
    CLEAN_ORDERS,
    GAPPY_ORDERS,
    gappy_orders,
    query,
    rounded,
    sql_iso,
    sql_round,
    table,
)

_STATS = {
    "mean": ("AVG({c})", 4),
    "median": ("MEDIAN({c})", 4),
    "std": ("STDDEV_SAMP({c})", 4),
    "min": ("MIN({c})", 4),
    "max": ("MAX({c})", 4),
    "sum": ("SUM({c})", 2),
    "q25": ("QUANTILE_CONT({c}, 0.25)", 4),
    "q75": ("QUANTILE_CONT({c}, 0.75)", 4),
    "iqr": ("QUANTILE_CONT({c}, 0.75) - QUANTILE_CONT({c}, 0.25)", 4),
}


def _numeric_sql(column: str, source: str) -> str:
    stats = ", ".join(
        f"{sql_round(f.format(c=column), digits)} AS {name}" for name, (f, digits) in _STATS.items()
    )
    return f"""SELECT '{column}' AS "column", COUNT({column}) AS count,
        COUNT(*) - COUNT({column}) AS null_count, {stats},
        {sql_round(f'(SELECT {column} FROM {source} AS m WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1)', 4)} AS mode
        FROM {source} AS s"""


def _numeric(df, columns):
    return rounded(round_stats(numeric_profile(df, columns)), sum=2)


_LINE_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]


@query("profile_numeric", " UNION ALL ".join(_numeric_sql(c, "lineitem") for c in _LINE_NUMBERS))
def profile_numeric(spark, folder):
    return _numeric(table(spark, folder, "lineitem"), _LINE_NUMBERS)


@query("profile_numeric_gaps", _numeric_sql("price", f"({GAPPY_ORDERS})"))
def profile_numeric_gaps(spark, folder):
    return _numeric(gappy_orders(spark, folder), ["price"])


@query(
    "quantiles_document_size",
    """SELECT 'n_chars' AS "column", QUANTILE_CONT(n_chars, 0.01) AS q0, QUANTILE_CONT(n_chars, 0.5) AS q1,
              QUANTILE_CONT(n_chars, 0.99) AS q2, QUANTILE_CONT(n_chars, 0.999) AS q3 FROM documents""",
)
def quantiles_document_size(spark, folder):
    return exact_quantiles(table(spark, folder, "documents"), ["n_chars"], (0.01, 0.5, 0.99, 0.999))


_TEXT = {"status": f"({GAPPY_ORDERS})", "priority": f"({GAPPY_ORDERS})"}
_WIDE_TEXT = {"lang": "documents", "source": "documents", "text": "documents"}


def _text_sql(column: str, source: str) -> str:
    return f"""SELECT '{column}' AS "column", COUNT({column}) AS count, COUNT(*) - COUNT({column}) AS null_count,
        COUNT(DISTINCT {column}) AS unique_count,
        (SELECT {column} FROM {source} AS m WHERE {column} IS NOT NULL
         GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1) AS mode_value FROM {source} AS s"""


def _top_sql(column: str, source: str) -> str:
    return f"""SELECT * FROM (SELECT '{column}' AS "column", {column} AS value, COUNT(*) AS count,
        {sql_round(f"COUNT(*) * 1.0 / (SELECT COUNT({column}) FROM {source} AS m) * 100", 1)} AS pct
        FROM {source} AS s WHERE {column} IS NOT NULL GROUP BY {column} ORDER BY 3 DESC, 2 LIMIT 10)"""


def _text(df, columns):
    return text_profile(df, columns).drop("top_values")


def _top(df, columns):
    return text_profile(df, columns).select("column", F.inline("top_values"))


@query("profile_text", " UNION ALL ".join(_text_sql(c, s) for c, s in _TEXT.items()))
def profile_text(spark, folder):
    return _text(gappy_orders(spark, folder), list(_TEXT))


@query("profile_text_documents", " UNION ALL ".join(_text_sql(c, s) for c, s in _WIDE_TEXT.items()))
def profile_text_documents(spark, folder):
    """Whole texts as values, most of them unique."""
    return _text(table(spark, folder, "documents"), list(_WIDE_TEXT))


@query("profile_top_values", " UNION ALL ".join(_top_sql(c, s) for c, s in _TEXT.items()))
def profile_top_values(spark, folder):
    return _top(gappy_orders(spark, folder), list(_TEXT))


@query("profile_top_values_documents", " UNION ALL ".join(_top_sql(c, s) for c, s in _WIDE_TEXT.items()))
def profile_top_values_documents(spark, folder):
    return _top(table(spark, folder, "documents"), list(_WIDE_TEXT))


@query(
    "value_frequencies",
    """SELECT 'p_brand' AS "column", p_brand AS value, COUNT(*) AS n FROM part GROUP BY 2
       UNION ALL SELECT 'p_type', p_type, COUNT(*) FROM part GROUP BY 2
       UNION ALL SELECT 'p_name', p_name, COUNT(*) FROM part GROUP BY 2""",
)
def value_frequencies(spark, folder):
    return value_counts(table(spark, folder, "part"), ["p_brand", "p_type", "p_name"])


def _date_sql(column: str, expression: str, source: str) -> str:
    first, last = f"MIN({expression})", f"MAX({expression})"
    return f"""SELECT '{column}' AS "column", COUNT({expression}) AS count,
        COUNT(*) - COUNT({expression}) AS null_count,
        {sql_iso(first)} AS min_date, {sql_iso(last)} AS max_date,
        CAST(floor(epoch({last} - {first}) / 86400) AS BIGINT) AS range_days FROM {source}"""


@query("profile_dates", _date_sql("l_shipdate", "l_shipdate", "lineitem"))
def profile_dates(spark, folder):
    return date_profile(table(spark, folder, "lineitem"), {"l_shipdate": None})


@query("profile_timestamps", _date_sql("ts", "ts", "events"))
def profile_timestamps(spark, folder):
    """The last event is earlier in the day than the first: elapsed days, not calendar days."""
    return date_profile(table(spark, folder, "events"), {"ts": None})


def _text_dates(spark, folder):
    """Orders whose dates are texts, in three layouts, next to texts that are no dates."""
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(F.col("o_totalprice") >= 60000, F.col("o_custkey")).alias("gappy_key"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("european"),
        F.date_format("o_orderdate", "yyyy").alias("year"),
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderstatus").alias("broken"),
        "o_orderstatus",
        (F.col("o_orderstatus") == "F").alias("finished"),
        "o_totalprice",
        "o_orderdate",
    )


_TYPES_SOURCE = """SELECT o_orderkey, CASE WHEN o_totalprice >= 60000 THEN o_custkey END AS gappy_key,
    strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%d/%m/%Y') AS european,
    strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%Y-%m-%d') || o_orderstatus AS broken,
    o_orderstatus, o_orderstatus = 'F' AS finished, o_totalprice, o_orderdate FROM orders"""


def _string_type_sql(position: int, column: str) -> str:
    parses = " OR ".join(
        f"COUNT(TRY_STRPTIME({column}, '{f}')) = COUNT({column})"
        for f in ("%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%Y/%m/%d", "%Y")
    )
    return f"""SELECT {position} AS position, '{column}' AS "column", CASE WHEN {parses} THEN 'date'
        WHEN COUNT(DISTINCT {column}) <= 50 AND COUNT(DISTINCT {column}) < 0.2 * COUNT({column}) THEN 'categorical'
        ELSE 'text' END AS semantic_type FROM s"""


def _number_type_sql(position: int, column: str) -> str:
    return f"""SELECT {position}, '{column}', CASE WHEN COUNT({column}) = COUNT(*)
        AND typeof(ANY_VALUE({column})) IN ('INTEGER', 'BIGINT') THEN 'integer' ELSE 'float' END FROM s"""


@query(
    "semantic_types",
    f"""WITH s AS ({_TYPES_SOURCE})
        {_string_type_sql(2, 'iso')} UNION ALL {_string_type_sql(3, 'european')}
        UNION ALL {_string_type_sql(4, 'year')} UNION ALL {_string_type_sql(5, 'broken')}
        UNION ALL {_string_type_sql(6, 'o_orderstatus')}
        UNION ALL {_number_type_sql(0, 'o_orderkey')} UNION ALL {_number_type_sql(1, 'gappy_key')}
        UNION ALL {_number_type_sql(8, 'o_totalprice')}
        UNION ALL SELECT 7, 'finished', 'boolean' FROM s HAVING COUNT(finished) = COUNT(*)
        UNION ALL SELECT 9, 'o_orderdate', 'date' FROM s HAVING COUNT(o_orderdate) > 0""",
)
def semantic_types(spark, folder):
    types = detect_types(_text_dates(spark, folder))
    return types_frame(spark, types).select("position", "column", "semantic_type")


@query(
    "profile_text_dates",
    " UNION ALL ".join(
        _date_sql(c, f"strptime({c}, '{f}')", f"({_TYPES_SOURCE})")
        for c, f in (("iso", "%Y-%m-%d"), ("european", "%d/%m/%Y"), ("year", "%Y"))
    ),
)
def profile_text_dates(spark, folder):
    return text_date_profile(_text_dates(spark, folder))


@query(
    "profile_nested",
    """SELECT 'vec_id' AS "column", 'integer' AS type, COUNT(vec_id) AS count, COUNT(*) - COUNT(vec_id) AS null_count FROM embeddings
       UNION ALL SELECT 'embedding', 'text', COUNT(embedding), COUNT(*) - COUNT(embedding) FROM embeddings
       UNION ALL SELECT 'label', 'integer', COUNT(label), COUNT(*) - COUNT(label) FROM embeddings""",
)
def profile_nested(spark, folder):
    """A nested column is reported as text with its filled and missing cells."""
    return describe(table(spark, folder, "embeddings")).profile.select("column", "type", "count", "null_count")


@query(
    "dataset_summary",
    f"""SELECT COUNT(*) AS row_count, 5 AS column_count, 'o_orderkey,price' AS numeric_columns,
        'o_orderdate' AS date_columns, 'status,priority' AS categorical_columns, '' AS text_columns,
        5 * COUNT(*) - COUNT(o_orderkey) - COUNT(price) - COUNT(status) - COUNT(priority) - COUNT(o_orderdate)
            AS missing_values FROM ({GAPPY_ORDERS})""",
)
def dataset_summary(spark, folder):
    summary = describe(gappy_orders(spark, folder)).summary()
    names = [c for c in summary.columns if c.endswith("_columns")]
    return summary.withColumns({n: F.array_join(n, ",") for n in names}).withColumn(
        "column_count", F.col("column_count").cast("int")
    )


@query(
    "dataset_description",
    f"""SELECT n AS row_count, 5 AS column_count, 2 AS numeric_count, 2 AS categorical_count, m AS missing_values,
        {sql_round('m * 1.0 / (n * 5) * 100', 1)} AS missing_pct FROM (
        SELECT COUNT(*) AS n, 5 * COUNT(*) - COUNT(o_orderkey) - COUNT(price) - COUNT(status)
               - COUNT(priority) - COUNT(o_orderdate) AS m FROM ({GAPPY_ORDERS}))""",
)
def dataset_description(spark, folder):
    numbers = describe_dataset(describe(gappy_orders(spark, folder)).summary())
    counts = ("column_count", "numeric_count", "categorical_count")
    return numbers.withColumns({n: F.col(n).cast("int") for n in counts})


@query(
    "compact_sample",
    "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer ORDER BY c_custkey LIMIT 30",
)
def compact_sample(spark, folder):
    return sample_rows(table(spark, folder, "customer"), F.col("c_custkey"))


def _sample_sql(column: str, kind: str) -> str:
    stats = ", ".join(
        f"{sql_round(f'{f}({column})', 4)} AS {n}"
        for n, f in (("mean", "AVG"), ("min", "MIN"), ("max", "MAX"), ("median", "MEDIAN"))
    )
    return f"""SELECT '{column}' AS "column", '{kind}' AS type, {stats}, CAST(NULL AS BIGINT) AS unique_count,
        CAST(NULL AS VARCHAR) AS top_values FROM customer"""


@query(
    "sample_statistics",
    f"""{_sample_sql('c_custkey', 'integer')} UNION ALL {_sample_sql('c_nationkey', 'integer')}
        UNION ALL {_sample_sql('c_acctbal', 'float')}
        UNION ALL SELECT 'c_mktsegment', 'categorical', NULL, NULL, NULL, NULL,
            (SELECT COUNT(DISTINCT c_mktsegment) FROM customer),
            (SELECT string_agg(v, ',' ORDER BY n DESC, v) FROM (SELECT c_mktsegment AS v, COUNT(*) AS n
             FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5))""",
)
def sample_statistics(spark, folder):
    stats = sample_stats(describe(table(spark, folder, "customer")).profile)
    return stats.withColumn("top_values", F.array_join("top_values", ","))


# All numbers of the table but l_linenumber, which is named like an identifier.
_VARIATIONS = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", STDDEV_SAMP({c}) / AVG({c}) AS score, {p} AS p FROM lineitem"
    for p, c in enumerate(
        ("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    )
)


@query(
    "best_numeric",
    f"""SELECT "column", {sql_round('score', 4)} AS score FROM ({_VARIATIONS}) ORDER BY score DESC, p LIMIT 1""",
)
def best_numeric(spark, folder):
    described = describe(table(spark, folder, "lineitem"))
    chosen = described.basic_profile.where(F.col("column") == choose_numeric(described.basics))
    return rounded(chosen.select("column", S.variation(F.col("std"), F.col("mean")).alias("score")), score=4)


@query(
    "best_categorical",
    """SELECT "column", unique_count FROM (
        SELECT 'o_orderstatus' AS "column", COUNT(DISTINCT o_orderstatus) AS unique_count, 0 AS p FROM orders
        UNION ALL SELECT 'o_orderpriority', COUNT(DISTINCT o_orderpriority), 1 FROM orders)
        WHERE unique_count BETWEEN 2 AND 20 ORDER BY p LIMIT 1""",
)
def best_categorical(spark, folder):
    described = describe(table(spark, folder, "orders"))
    chosen = described.basic_profile.where(F.col("column") == choose_categorical(described.basics))
    return chosen.select("column", "unique_count")


@query(
    "ingested_profile",
    f"""WITH c AS ({CLEAN_ORDERS})
        SELECT 'o_orderkey' AS "column", 'integer' AS type, COUNT(o_orderkey) AS count,
               {sql_round('AVG(o_orderkey)', 4)} AS mean, CAST(NULL AS BIGINT) AS unique_count FROM c
        UNION ALL SELECT 'price', 'float', COUNT(price), {sql_round('AVG(price)', 4)}, NULL FROM c
        UNION ALL SELECT 'status', 'categorical', COUNT(status), NULL, COUNT(DISTINCT status) FROM c
        UNION ALL SELECT 'priority', 'categorical', COUNT(priority), NULL, COUNT(DISTINCT priority) FROM c
        UNION ALL SELECT 'o_orderdate', 'date', COUNT(o_orderdate), NULL, NULL FROM c""",
)
def ingested_profile(spark, folder):
    """Clean and describe in one go."""
    profile = ingest(spark, gappy_orders(spark, folder)).described.profile
    return rounded(profile.select("column", "type", "count", "mean", "unique_count"), mean=4)


@query(
    "scalar_texts",
    f"""SELECT event_id, {sql_iso('ts')} AS iso, {sql_round('value / 8', 1)} AS r1, {sql_round('value / 8', 2)} AS r2,
        {sql_round('value / 8', 3)} AS r3, {sql_round('value / 8', 4)} AS r4,
        CASE WHEN value < 50 THEN 'True' ELSE 'False' END AS flag,
        CASE WHEN value = 0 THEN NULL ELSE 1 / value END AS inverse,
        event_id % 4 < 3 AS named,
        strptime(strftime(ts, '%Y-%m-%d'), '%Y-%m-%d') AS day FROM events""",
)
def scalar_texts(spark, folder):
    events = table(spark, folder, "events")
    eighth = F.col("value") / 8
    flag = F.col("value") < 50
    # Names that hit each fixed token, and some that hit none.
    name = F.element_at(F.array(*map(F.lit, ("row_ID", "Index 2", "NUMBER", "total"))), (F.col("event_id") % 4 + 1).cast("int"))
    return events.select(
        "event_id",
        S.iso_text(F.col("ts"), field_type(events, "ts")).alias("iso"),
        *[S.exact_round(eighth, d).alias(f"r{d}") for d in (1, 2, 3, 4)],
        S.label_text(flag, T.BooleanType()).alias("flag"),
        S.ratio(F.lit(1), F.col("value")).alias("inverse"),
        S.looks_like_id(name).alias("named"),
        S.parse_timestamp(F.date_format("ts", "yyyy-MM-dd"), "yyyy-MM-dd").alias("day"),
    )
