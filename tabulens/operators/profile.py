"""Per-column statistics: one row per column."""

from __future__ import annotations

from collections.abc import Hashable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens.functions.columns import aggregated, col, data_fields, field_type, is_large, is_numeric, is_temporal
from tabulens.functions.scalars import (
    exact_round,
    iso_text,
    is_missing,
    nan_to_null,
    parse_timestamp,
    percent,
    total,
)
from tabulens.operators.frequency import (
    PREFIX,
    SHORT,
    countable,
    likely_top,
    printed,
    texts_of,
    token,
    top_values,
    value_counts,
)
from tabulens.operators.quantiles import ACCURACY, QUARTILES, certain_modes, first_brackets, likely_modes, pick, settle
from tabulens.operators.types import ColumnType, by_kind, text_dates

TOP_VALUES = 10

NUMERIC_STATS = ("mean", "median", "mode", "std", "min", "max", "sum", "q25", "q75", "iqr")

#: The combined profile has all of these; a statistic that does not apply is NULL.
PROFILE_SCHEMA = T.StructType(
    [
        T.StructField("position", T.IntegerType()),
        T.StructField("column", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("count", T.LongType()),
        T.StructField("null_count", T.LongType()),
        *[T.StructField(s, T.DoubleType()) for s in NUMERIC_STATS],
        T.StructField("min_date", T.StringType()),
        T.StructField("max_date", T.StringType()),
        T.StructField("range_days", T.LongType()),
        T.StructField("unique_count", T.LongType()),
        T.StructField("mode_value", T.StringType()),
        T.StructField(
            "top_values",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("value", T.StringType()),
                        T.StructField("count", T.LongType()),
                        T.StructField("pct", T.DoubleType()),
                    ]
                )
            ),
        ),
    ]
)


def profile_frame(spark: SparkSession, rows: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Rows of statistics, one per column, as a table; absent statistics are NULL."""
    return spark.createDataFrame([tuple(r.get(n) for n in PROFILE_SCHEMA.names) for r in rows], PROFILE_SCHEMA)


def _moment(df: DataFrame, name: str, fmt: str | None) -> Column:
    return parse_timestamp(col(name), fmt) if fmt else col(name).cast("timestamp_ntz")


def _aggregates(df: DataFrame, name: str, fmt: str | None = None, approx: bool = False) -> dict[str, Column]:
    """What a single scan can tell about a column."""
    dtype = field_type(df, name)
    missing = is_missing(col(name), dtype)
    found = {"count": F.count_if(~missing), "null_count": F.count_if(missing)}
    if is_numeric(dtype):
        value = nan_to_null(col(name), dtype)
        number = value.cast("double")
        found |= {
            "mean": F.avg(number),
            "std": F.stddev_samp(number),
            "min": F.min(value).cast("double"),
            "max": F.max(value).cast("double"),
            "sum": total(value, dtype),
        }
        if approx:
            found["quartiles"] = F.percentile_approx(number, list(QUARTILES), ACCURACY)
    elif fmt or is_temporal(dtype):
        ntz = T.TimestampNTZType()
        first, last = (f(_moment(df, name, fmt)) for f in (F.min, F.max))
        found |= {
            "min_date": iso_text(first, ntz),
            "max_date": iso_text(last, ntz),
            "range_days": F.extract(F.lit("DAY"), last - first).cast("bigint"),
        }
    return found


def scan_columns(
    df: DataFrame,
    columns: Sequence[str],
    formats: Mapping[str, str],
    approx: bool = False,
    also: Mapping[Hashable, Column] | None = None,
) -> dict[str, dict[str, Any]]:
    """Counts, moments and date ranges of all columns from one scan.

    ``formats`` has the layouts of string dates.  The values of the aggregates in
    ``also`` are found under None.
    """
    wanted = {
        (name, stat): value
        for name in columns
        for stat, value in _aggregates(df, name, formats.get(name), approx).items()
    }
    values = aggregated(df, wanted | {(None, key): value for key, value in (also or {}).items()})
    found: dict = {name: {"column": name} for name in columns}
    for (name, stat), value in values.items():
        found.setdefault(name, {})[stat] = value
    return found


def date_aggregates(df: DataFrame, candidates: Mapping[str, Sequence[str]]) -> dict[tuple[str, str, str], Column]:
    """By column, layout and statistic: date ranges of texts under every layout that they may follow."""
    stats = ("min_date", "max_date", "range_days")
    return {
        (name, fmt, stat): _aggregates(df, name, fmt)[stat] for name, layouts in candidates.items() for fmt in layouts for stat in stats
    }


def add_quantiles(
    df: DataFrame, columns: Sequence[str], scanned: Mapping[str, dict[str, Any]], approx: bool = False
) -> None:
    """Complete the scanned statistics of numeric columns with quartiles, iqr and mode.

    Exact quartiles and modes take a scan that shuffles the distinct values,
    after one that draws a sample.  In a large table a sketch may prove what a
    column's mode is; then only values around its quartiles are shuffled.
    ``approx=True`` takes quartiles from a sketch, and modes from the values that
    a sketch takes for frequent.
    """
    columns = list(columns)
    if approx:
        quartiles = {n: scanned[n].pop("quartiles") or [None] * 3 for n in columns}
        modes = likely_modes(df, columns)
    else:
        brackets = [
            b
            for i, n in enumerate(columns)
            for b in first_brackets(
                i, *(scanned[n][s] for s in ("count", "min", "max")), QUARTILES
            )
        ]
        settle(df, columns, brackets)
        modes = certain_modes(df, columns, [scanned[n]["count"] for n in columns]) if is_large(df) else {}
        found, _ = pick(df, columns, [b for b in brackets if b.source in modes])
        others, counted = pick(df, columns, [b for b in brackets if b.source not in modes], modes=True)
        found, modes = found | others, modes | counted
        quartiles = {n: [found.get((i, j)) for j in range(3)] for i, n in enumerate(columns)}
    for i, name in enumerate(columns):
        q25, median, q75 = quartiles[name]
        iqr = None if q25 is None else q75 - q25
        scanned[name] |= {"q25": q25, "median": median, "q75": q75, "iqr": iqr, "mode": modes.get(i)}


def numeric_profile(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """``column, count, null_count`` and the ten numeric statistics, unrounded."""
    scanned = scan_columns(df, columns, {}, approx)
    add_quantiles(df, columns, scanned, approx)
    profile = profile_frame(df.sparkSession, [scanned[n] for n in columns])
    return profile.select("column", "count", "null_count", *NUMERIC_STATS)


def date_profile(df: DataFrame, formats: Mapping[str, str | None]) -> DataFrame:
    """``column, count, null_count, min_date, max_date, range_days``.

    ``formats`` maps each column to the layout of its texts, or to None for
    real dates and timestamps.  Range is elapsed whole days, not calendar days.
    """
    names = list(formats)
    rows = []
    aggregates = []
    for i, name in enumerate(names):
        stats = _aggregates(df, name, formats[name])
        aggregates += [a.alias(f"{s}_{i}") for s, a in stats.items()]
        rows.append(F.struct(F.lit(name).alias("column"), *[F.col(f"{s}_{i}").alias(s) for s in stats]))
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def text_date_profile(df: DataFrame) -> DataFrame:
    """``date_profile`` of the string columns that hold dates, found and measured in two aggregates."""
    found = text_dates(df, lambda name, fmt: _aggregates(df, name, fmt))
    names = ("count", "null_count", "min_date", "max_date", "range_days")
    return df.sparkSession.createDataFrame(
        [(n, *(row[s] for s in names)) for n, row in found.items()],
        "column string, count long, null_count long, min_date string, max_date string, range_days long",
    )


def round_stats(profile: DataFrame, digits: int = 4) -> DataFrame:
    """Display rounding of the numeric statistics."""
    return profile.select(
        *[
            (exact_round(col(n), digits) if n in NUMERIC_STATS else col(n)).alias(n)
            for n in profile.columns
        ]
    )


def token_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, count, unique_count, longest, top`` over the stand-ins of values.

    ``top`` holds one entry more than is reported.  Counts and top entries both
    come from one shuffled frequency table.
    """
    frequencies = value_counts(df, columns, shorten=True)
    sizes = frequencies.groupBy("column").agg(
        F.sum("n").alias("count"),
        F.count(F.lit(1)).alias("unique_count"),
        F.max(F.length("value")).alias("longest"),
    )
    # At most TOP_VALUES + 1 rows per column reach this list.
    top = (
        top_values(frequencies, TOP_VALUES + 1)
        .groupBy("column")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))).alias("top"))
    )
    # One row per column of the schema on both sides.
    return sizes.join(F.broadcast(top), "column")


def text_values(df: DataFrame, columns: Sequence[str]) -> dict[str, dict[str, Any]]:
    """``unique_count, mode_value, top_values`` by column, for columns with values.

    Values are ordered by count, then by value; the mode is the first of them.
    Long texts are shuffled as stand-ins.  The few that are reported are looked
    up in a second scan; a column where stand-ins cannot tell which those are
    is counted again with its whole texts.
    """
    summaries = {r["column"]: r for r in token_summary(df, columns).collect()}
    tops = {n: [(t["value"], t["n"]) for t in r["top"]] for n, r in summaries.items()}
    long = {n for n, r in summaries.items() if r["longest"] > SHORT}
    unclear = [n for n in long if _cut_through_ties(tops[n])]
    hidden = {n: [v for v, _ in tops[n][:TOP_VALUES] if len(v) > SHORT] for n in long}
    hidden = {n: tokens for n, tokens in hidden.items() if tokens and n not in unclear}

    texts = texts_of(df, hidden) if hidden else {}
    for name in hidden:
        tops[name] = [(texts.get((name, v), v), n) for v, n in tops[name][:TOP_VALUES]]
    if unclear:
        best = top_values(value_counts(df, unclear), TOP_VALUES).collect()
        tops |= {n: [(r["value"], r["n"]) for r in best if r["column"] == n] for n in unclear}

    found = {}
    for name, row in summaries.items():
        found[name] = _reported(tops[name], row["unique_count"], row["count"])
    return found


def _reported(top: list[tuple[str, int]], unique: int, rows: int) -> dict[str, Any]:
    # Code point order of Python strings is the byte order of Spark's.
    top = sorted(top, key=lambda t: (-t[1], t[0]))[:TOP_VALUES]
    return {
        "unique_count": unique,
        "mode_value": top[0][0],
        "top_values": [{"value": v, "count": n, "pct": round(n / rows * 100, 1)} for v, n in top],
    }


def likely_values(df: DataFrame, columns: Sequence[str], rows: Mapping[str, int]) -> dict[str, dict[str, Any]]:
    """As ``text_values``, from sketches: distinct counts are estimates, and values are chosen among
    those that a sketch takes for frequent.  These are counted exactly.  ``rows`` has the number of
    values by column."""
    values = {n: token(printed(df, n)) for n in columns}
    sketches = []
    for i, (name, value) in enumerate(values.items()):
        sketches.append(F.approx_count_distinct(col(name)).alias(f"unique{i}"))
        sketches.append(likely_top(value, 2 * TOP_VALUES).alias(f"likely{i}"))
    sketched = df.agg(*sketches).first()
    likely = {n: [v for v in sketched[f"likely{i}"] if v is not None] for i, n in enumerate(columns)}
    likely = {n: found for n, found in likely.items() if found}
    if not likely:
        return {}
    best = top_values(value_counts(df, list(likely), shorten=True, only=likely), TOP_VALUES).collect()
    long = {n: [r["value"] for r in best if r["column"] == n and len(r["value"]) > SHORT] for n in likely}
    long = {n: tokens for n, tokens in long.items() if tokens}
    texts = texts_of(df, long) if long else {}
    found = {}
    for i, name in enumerate(columns):
        if name in likely:
            top = [(texts.get((name, r["value"]), r["value"]), r["n"]) for r in best if r["column"] == name]
            found[name] = _reported(top, sketched[f"unique{i}"], rows[name])
    return found


def _cut_through_ties(top: list[tuple[str, int]]) -> bool:
    """Whether the last reported entry and the next one only differ beyond the kept start."""
    if len(top) <= TOP_VALUES:
        return False
    (last, n), (following, m) = top[TOP_VALUES - 1 :]
    return n == m and last[:PREFIX] == following[:PREFIX]


def add_values(
    df: DataFrame, columns: Sequence[str], scanned: Mapping[str, dict[str, Any]], approx: bool = False
) -> None:
    """Complete the scanned statistics of non-numeric columns with their values.

    ``approx=True`` takes them from sketches.
    """
    plain = [n for n in columns if countable(field_type(df, n))]
    if plain:
        rows = {n: scanned[n]["count"] for n in plain}
        found = likely_values(df, plain, rows) if approx else text_values(df, plain)
        for name in plain:
            scanned[name] |= found.get(name, {"unique_count": 0, "top_values": []})


def text_profile(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """``column, count, null_count, unique_count, mode_value, top_values``.

    Nested columns get counts only.
    """
    scanned = scan_columns(df, columns, {}, approx)
    add_values(df, columns, scanned, approx)
    profile = profile_frame(df.sparkSession, [scanned[n] for n in columns])
    return profile.select("column", "count", "null_count", "unique_count", "mode_value", "top_values")


def dataset_summary(types: list[ColumnType], profile: DataFrame, rows: int) -> DataFrame:
    """One row: sizes, column names by kind and the number of missing cells."""
    kinds = by_kind(types)
    missing = F.coalesce(F.sum("null_count"), F.lit(0)).cast("bigint")
    names = {k: F.array(*[F.lit(n) for n in v]).cast("array<string>") for k, v in kinds.items()}
    return profile.agg(missing.alias("missing_values")).select(
        F.lit(rows).cast("bigint").alias("row_count"),
        F.lit(len(types)).cast("bigint").alias("column_count"),
        *[v.alias(f"{k}_columns") for k, v in names.items()],
        "missing_values",
    )


def describe_dataset(summary: DataFrame) -> DataFrame:
    """Numbers of the text description: sizes, column counts, share of missing cells."""
    cells = F.col("row_count") * F.col("column_count")
    return summary.select(
        "row_count",
        "column_count",
        F.size("numeric_columns").cast("bigint").alias("numeric_count"),
        F.size("categorical_columns").cast("bigint").alias("categorical_count"),
        "missing_values",
        F.coalesce(exact_round(percent(F.col("missing_values"), cells), 1), F.lit(0.0)).alias(
            "missing_pct"
        ),
    )


def sample_rows(df: DataFrame, order: Column, rows: int = 30) -> DataFrame:
    """First rows in ingestion order, timestamps as ISO text and NaN as NULL."""
    fields = data_fields(df)
    return (
        df.orderBy(order)
        .limit(rows)
        .select(
            *[
                (
                    iso_text(col(f.name), f.dataType)
                    if is_temporal(f.dataType)
                    else nan_to_null(col(f.name), f.dataType)
                ).alias(f.name)
                for f in fields
            ]
        )
    )


def sample_stats(profile: DataFrame) -> DataFrame:
    """Compact statistics of numeric and categorical columns; others are left out."""
    numeric = F.col("type").isin("integer", "float")
    shown = {s: F.when(numeric, exact_round(F.col(s), 4)) for s in ("mean", "min", "max", "median")}
    category = F.col("type") == "categorical"
    return profile.where(numeric | category).select(
        "column",
        "type",
        *[v.alias(s) for s, v in shown.items()],
        F.when(category, F.col("unique_count")).alias("unique_count"),
        F.when(
            category, F.transform(F.slice("top_values", 1, 5), lambda t: t["value"])
        ).alias("top_values"),
    )
