"""Missing-value cleaning: mean imputation for numbers, row removal for the rest."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.functions.columns import col, data_fields, is_numeric
from tabulens.functions.scalars import normalise_missing


def _drop_reason(names: list[str]) -> Column:
    """Index of the first non-numeric column, in table order, that lacks a value."""
    if not names:
        return F.lit(None).cast("int")
    return F.coalesce(*[F.when(col(n).isNull(), F.lit(i)) for i, n in enumerate(names)])


def cleaning_report(df: DataFrame) -> DataFrame:
    """``column, action, count, fill_value`` plus one ``rows_before`` and ``rows_after`` row.

    Means cover all rows, before any is removed.  A removed row is charged to
    the first column that lacks a value.  Everything comes from one scan.
    """
    df = normalise_missing(df)
    fields = data_fields(df)
    numbers = [f.name for f in fields if is_numeric(f.dataType)]
    others = [f.name for f in fields if not is_numeric(f.dataType)]

    reason = _drop_reason(others)
    counts = [F.count(F.lit(1)).alias("rows"), F.count(reason).alias("dropped")]
    counts += [F.count_if(reason == i).alias(f"drop{i}") for i in range(len(others))]
    for i, name in enumerate(numbers):
        counts.append(F.count_if(col(name).isNull()).alias(f"fill{i}"))
        counts.append(F.avg(col(name).cast("double")).alias(f"mean{i}"))

    def entry(column: str | None, action: str, count: Column, value: Column | None = None) -> Column:
        value = F.lit(None) if value is None else value
        return F.struct(
            F.lit(column).cast("string").alias("column"),
            F.lit(action).alias("action"),
            count.cast("bigint").alias("count"),
            value.cast("double").alias("fill_value"),
        )

    entries = [entry(n, "filled", F.col(f"fill{i}"), F.col(f"mean{i}")) for i, n in enumerate(numbers)]
    entries += [entry(n, "rows_dropped", F.col(f"drop{i}")) for i, n in enumerate(others)]
    entries.append(entry(None, "rows_before", F.col("rows")))
    entries.append(entry(None, "rows_after", F.col("rows") - F.col("dropped")))
    report = df.agg(*counts).select(F.inline(F.array(*entries)))
    return report.where((F.col("count") > 0) | F.col("column").isNull())


@dataclass
class Cleaned:
    """A cleaned table, still lazy, with what was done to it."""

    frame: DataFrame
    filled: dict[str, tuple[int, float | None]]
    dropped: dict[str, int]
    rows_before: int
    rows_after: int

    @property
    def had_gaps(self) -> set[str]:
        return set(self.filled) | set(self.dropped)

    def as_dict(self) -> dict[str, Any]:
        """The report with display rounding."""
        return {
            "numeric_filled": {
                n: {"count": c, "fill_value": None if v is None else round(v, 4)}
                for n, (c, v) in self.filled.items()
            },
            "text_rows_dropped": dict(self.dropped),
            "rows_before": self.rows_before,
            "rows_after": self.rows_after,
        }


def apply_cleaning(df: DataFrame, means: dict[str, float | None]) -> DataFrame:
    """Fill the named numeric columns and drop rows that lack any non-numeric value.

    A filled column becomes double; untouched columns keep their type.
    """
    df = normalise_missing(df)
    others = [f.name for f in data_fields(df) if not is_numeric(f.dataType)]
    filled = {
        n: F.coalesce(col(n).cast("double"), F.lit(mean).cast("double")).alias(n)
        for n, mean in means.items()
    }
    kept = df
    for name in others:
        kept = kept.where(col(name).isNotNull())
    return kept.select(*[filled.get(n, col(n)) for n in df.columns]) if filled else kept


def clean_table(df: DataFrame) -> Cleaned:
    """Run the report (one scan) and return the cleaned table on top of the same input."""
    rows = cleaning_report(df).collect()
    filled = {r["column"]: (r["count"], r["fill_value"]) for r in rows if r["action"] == "filled"}
    dropped = {r["column"]: r["count"] for r in rows if r["action"] == "rows_dropped"}
    size = {r["action"]: r["count"] for r in rows if r["column"] is None}
    frame = apply_cleaning(df, {n: mean for n, (_, mean) in filled.items()})
    return Cleaned(frame, filled, dropped, size["rows_before"], size["rows_after"])
