"""Structural checks on a raw table."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens.functions.columns import POSITION, chunks, col, data_fields
from tabulens.functions.scalars import is_missing

# Shares of empty cells that are an error, and worth a warning.
MAX_MISSING = 0.05
WARN_MISSING = 0.02

_COLUMNS_PER_PASS = 256

_CHECK_SCHEMA = "check string, severity string, metric double, detail string"
_SUMMARY_SCHEMA = "valid boolean, row_count bigint, column_count bigint, missing_pct double"


@dataclass
class Validation:
    """Outcome of the checks; row and column counts leave out tolerated empties."""

    row_count: int = 0
    column_count: int = 0
    missing_pct: float = 0.0
    checks: list[tuple[str, str, float, str]] = field(default_factory=list)

    @property
    def valid(self) -> bool:
        return not self.errors

    @property
    def errors(self) -> list[str]:
        return [check for check, severity, *_ in self.checks if severity == "error"]

    @property
    def warnings(self) -> list[str]:
        return [check for check, severity, *_ in self.checks if severity == "warning"]

    def note(self, check: str, severity: str, metric: float, detail: str = "") -> None:
        self.checks.append((check, severity, float(metric), detail))

    def checks_frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.checks, _CHECK_SCHEMA)

    def summary_frame(self, spark) -> DataFrame:
        row = (self.valid, self.row_count, self.column_count, self.missing_pct)
        return spark.createDataFrame([row], _SUMMARY_SCHEMA)


def row_order(df: DataFrame, order_by: Sequence[str] | None) -> Column:
    if order_by:
        return F.struct(*[col(n) for n in order_by])
    if POSITION in df.columns:
        return col(POSITION)
    raise ValueError("row order is unknown: pass order_by or scan with a position")


def validate_table(
    df: DataFrame,
    order_by: Sequence[str] | None = None,
    header: Sequence[str] | None = None,
) -> Validation:
    """Check that the table is one contiguous block with few gaps.

    ``header`` is the raw first line of a delimited file; without it the
    column names themselves are checked.  All counts come from one aggregate;
    a second one runs only if the table has an empty row.
    """
    fields = data_fields(df)
    names = [f.name for f in fields]
    result = Validation()
    if not fields:
        result.note("empty_table", "error", 0, "no columns")
        return result

    missing = [is_missing(col(f.name), f.dataType) for f in fields]
    empty_row = reduce(and_, missing)
    rows, empty_rows, present = _count_cells(df, empty_row, missing)
    if rows == 0:
        result.note("empty_table", "error", 0, "no rows")
        return result

    if empty_rows and _check_stacked(df, empty_row, row_order(df, order_by), result):
        rows -= empty_rows
    kept = _check_side_by_side(names, present, result)
    result.row_count, result.column_count = rows, kept

    cells = rows * kept
    if cells:
        gaps = cells - sum(present)
        result.missing_pct = round(gaps / cells, 4)
        if result.missing_pct > MAX_MISSING:
            result.note("missing_cells", "error", result.missing_pct, f"{gaps} of {cells}")
        elif result.missing_pct > WARN_MISSING:
            result.note("missing_cells", "warning", result.missing_pct, f"{gaps} of {cells}")
    _check_names(names, present, list(header) if header is not None else names, kept, result)
    return result


def _count_cells(
    df: DataFrame, empty_row: Column, missing: list[Column]
) -> tuple[int, int, list[int]]:
    """Rows, all-empty rows and filled cells per column."""
    rows = empty_rows = 0
    present: list[int] = []
    for group in chunks(missing, _COLUMNS_PER_PASS):
        counts = [F.count_if(~m).alias(f"c{i}") for i, m in enumerate(group)]
        if not present:
            counts = [F.count(F.lit(1)).alias("rows"), F.count_if(empty_row).alias("empty"), *counts]
        row = df.agg(*counts).first()
        if not present:
            rows, empty_rows, *row = row
        present += list(row)
    return rows, empty_rows, present


def _literal(value, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StructType):
        return F.struct(*[_literal(v, f.dataType).alias(f.name) for v, f in zip(value, dtype.fields)])
    return F.lit(value).cast(dtype)


def _check_stacked(df: DataFrame, empty_row: Column, order: Column, result: Validation) -> bool:
    """Two or more filled rows after the first empty one: a second table below."""
    first = df.agg(F.min(F.when(empty_row, order)).alias("first"))
    place = _literal(first.first()["first"], first.schema["first"].dataType)
    after = df.where(~empty_row & (order > place)).count()
    if after > 1:
        result.note("stacked_tables", "error", after, "filled rows after an empty row")
        return False
    result.note("empty_rows", "warning", after, "empty rows are ignored")
    return True


def _check_side_by_side(names: list[str], present: list[int], result: Validation) -> int:
    """A filled column after an empty one: a second table to the right."""
    empty = [i for i, n in enumerate(present) if n == 0]
    if not empty:
        return len(names)
    beyond = [names[i] for i in range(empty[0], len(names)) if present[i] > 0]
    if beyond:
        result.note("side_by_side_tables", "error", len(beyond), ", ".join(beyond))
        return len(names)
    result.note("empty_columns", "warning", len(empty), ", ".join(names[i] for i in empty))
    return len(names) - len(empty)


def _check_names(
    names: list[str], present: list[int], header: list[str], kept: int, result: Validation
) -> None:
    checked = [
        header[i] if i < len(header) else n
        for i, n in enumerate(names)
        if kept == len(names) or present[i] > 0
    ]
    unnamed = [n for n in checked if not n.strip() or re.match(r"Unnamed:|_c\d+$", n)]
    if unnamed:
        result.note("unnamed_columns", "warning", len(unnamed), ", ".join(unnamed))
    repeated = [n for i, n in enumerate(checked) if n.strip() and n in checked[:i]]
    if repeated:
        result.note("duplicate_columns", "error", len(repeated), ", ".join(repeated))
