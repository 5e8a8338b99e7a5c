"""Semantic type detection."""

from __future__ import annotations

import re
from collections.abc import Callable, Collection, Mapping, Sequence
from dataclasses import astuple, dataclass
from functools import reduce
from operator import add
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens.functions.columns import (
    aggregated,
    col,
    data_fields,
    is_boolean,
    is_fractional,
    is_integral,
    is_temporal,
    is_text,
)
from tabulens.functions.scalars import date_shape, layouts_of, parse_timestamp
from tabulens.operators.frequency import distinct_sketches, distinct_values, narrow_columns

# A string column is categorical below both limits.
MAX_CATEGORY_SHARE = 0.2
MAX_CATEGORIES = 50

SCHEMA = (
    "position int, column string, dtype string, semantic_type string, "
    "is_numeric boolean, is_date boolean, is_categorical boolean, date_format string"
)


@dataclass(frozen=True)
class ColumnType:
    """One row of the type table; ``date_format`` is set for string dates."""

    position: int
    column: str
    dtype: str
    semantic_type: str
    is_numeric: bool = False
    is_date: bool = False
    is_categorical: bool = False
    date_format: str | None = None


def types_frame(spark: SparkSession, types: list[ColumnType]) -> DataFrame:
    return spark.createDataFrame([astuple(t) for t in types], SCHEMA)


def detect_types(
    df: DataFrame, infer_strings: bool = True, had_gaps: Collection[str] = ()
) -> list[ColumnType]:
    """Semantic type of every column, in table order; see ``classify``.

    Two aggregates: filled cells, shapes of texts and sketches of their values,
    then the layouts that fit and the values of the few columns with few.
    """
    fields = data_fields(df)
    texts = [f.name for f in fields if is_text(f.dataType)] if infer_strings else []
    others = [f.name for f in fields if is_boolean(f.dataType)] if infer_strings else []
    first = aggregated(
        df,
        {("rows", ""): F.count(F.lit(1))}
        | {("filled", f.name): F.count(col(f.name)) for f in fields}
        | {("values", n): v for n, v in distinct_sketches(df, texts + others).items()}
        | shapes_of(texts),
    )
    present = {f.name: (first["filled", f.name], first["rows", ""]) for f in fields}
    candidates = candidate_layouts(first, texts)
    gaps = {n for n, (filled, rows) in present.items() if filled < rows} | set(had_gaps)
    undecided = [f.name for f in fields if infer_strings and may_be_category(f, gaps)]
    narrow = narrow_columns({n: first["values", n] for n in undecided if ("values", n) in first}, MAX_CATEGORIES)
    second = aggregated(
        df, layout_masks(candidates) | {("distinct", n): distinct_values(df, n) for n in narrow}
    )
    distinct = {n: len(second["distinct", n]) for n in narrow}
    return classify(fields, present, first_layouts(second, candidates), distinct, infer_strings, had_gaps)


def may_be_category(field: T.StructField, gaps: Collection[str]) -> bool:
    """Texts, and booleans with gaps, which are no booleans any more."""
    return is_text(field.dataType) or (is_boolean(field.dataType) and field.name in gaps)


def classify(
    fields: Sequence[T.StructField],
    present: Mapping[str, tuple[int, int]],
    dates: Mapping[str, str],
    distinct: Mapping[str, int | None],
    infer_strings: bool = True,
    had_gaps: Collection[str] = (),
) -> list[ColumnType]:
    """Types from filled cells and rows, date formats and distinct counts per column.

    ``had_gaps`` names columns that lacked values before cleaning: integers
    with gaps count as floats, booleans with gaps as plain values.  With
    ``infer_strings=False`` strings and such booleans are always text.
    """
    gaps = {n for n, (filled, rows) in present.items() if filled < rows} | set(had_gaps)
    types = []
    for i, f in enumerate(fields):
        name, dtype, kind = f.name, f.dataType, "text"
        filled = present[name][0]
        if is_boolean(dtype) and name not in gaps:
            kind = "boolean"
        elif is_fractional(dtype) or (is_integral(dtype) and name in gaps):
            kind = "float"
        elif is_integral(dtype):
            kind = "integer"
        elif is_temporal(dtype) or (infer_strings and name in dates and filled):
            kind = "date"
        elif infer_strings and filled and may_be_category(f, gaps):
            values = distinct.get(name)
            if values is not None and values <= MAX_CATEGORIES and values / filled < MAX_CATEGORY_SHARE:
                kind = "categorical"
        types.append(
            ColumnType(
                i,
                name,
                dtype.simpleString(),
                kind,
                kind in ("integer", "float"),
                kind == "date",
                kind == "categorical",
                dates.get(name) if kind == "date" else None,
            )
        )
    return types


def date_formats(df: DataFrame, fields: Sequence[T.StructField]) -> dict[str, str]:
    """First layout that fits every value, for string columns that have one.

    Values of one column must share a shape, such as digits between two slashes.
    One aggregate finds the shapes, another the layouts of those that are a date's.
    """
    texts = [f.name for f in fields if is_text(f.dataType)]
    candidates = candidate_layouts(aggregated(df, shapes_of(texts)), texts)
    return first_layouts(aggregated(df, layout_masks(candidates)), candidates)


def text_dates(df: DataFrame, moments: Callable[[str, str], Mapping[str, Column]]) -> dict[str, dict[str, Any]]:
    """Per string column with a layout: the layout as ``format``, and what ``moments`` has for it, in two aggregates."""
    texts = [f.name for f in data_fields(df) if is_text(f.dataType)]
    candidates = candidate_layouts(aggregated(df, shapes_of(texts)), texts)
    wanted = {(n, layout, s): v for n, ls in candidates.items() for layout in ls for s, v in moments(n, layout).items()}
    found = aggregated(df, layout_masks(candidates) | wanted)
    formats = first_layouts(found, candidates)
    return {
        n: {"format": fmt} | {s: found[n, fmt, s] for s in moments(n, fmt)}
        for n, fmt in formats.items()
    }


def shapes_of(columns: Sequence[str]) -> dict[tuple[str, str], Column]:
    """The least and the greatest shape of each column's values."""
    return {(edge, n): f(date_shape(col(n))) for n in columns for edge, f in (("low", F.min), ("high", F.max))}


def candidate_layouts(shapes: Mapping[tuple[str, str], str | None], columns: Sequence[str]) -> dict[str, tuple[str, ...]]:
    """Layouts of the one shape that all values of a column have."""
    found = {n: layouts_of(shapes["low", n]) for n in columns if shapes["low", n] == shapes["high", n]}
    return {n: layouts for n, layouts in found.items() if layouts}


_PARTS = {
    "yyyy": "[0-9]{3,}",
    "yyyyMMdd": "[0-9]{8,}",
    "M": "0*(?:1[0-2]|[1-9])",
    "d": "0*(?:3[01]|[12][0-9]|[1-9])",
}


def may_follow(value: Column, layout: str) -> Column:
    """False where a date's numbers cannot be those of a layout; parsing such a text takes far longer."""
    date = re.match("[A-Za-z]+(?:[-/.][A-Za-z]+)*", layout)
    parts = re.split("([-/.])", date[0]) if date else []
    if not parts or not all(p in _PARTS for p in parts[::2]):
        return F.lit(True)
    return value.rlike("^" + "".join(_PARTS.get(p, f"[{p}]") for p in parts))


def layout_masks(candidates: Mapping[str, Sequence[str]]) -> dict[tuple[str, str], Column]:
    """A bit per layout of a column that is set if all values follow it.

    Masks of parts of a table combine by AND, so tasks send one number each.
    """
    masks = {}
    for name, layouts in candidates.items():
        fits = [may_follow(col(name), fmt) & parse_timestamp(col(name), fmt).isNotNull() for fmt in layouts]
        bits = [F.when(fit, 1 << i).otherwise(0) for i, fit in enumerate(fits)]
        masks["layouts", name] = F.bit_and(F.when(col(name).isNotNull(), reduce(add, bits)))
    return masks


def fitting_layouts(found: Mapping[tuple, int | None], candidates: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    """The layouts of each column whose bits are set, for columns with any."""
    fitting = {n: [fmt for i, fmt in enumerate(ls) if (found["layouts", n] or 0) >> i & 1] for n, ls in candidates.items()}
    return {n: layouts for n, layouts in fitting.items() if layouts}


def first_layouts(found: Mapping[tuple, int | None], candidates: Mapping[str, Sequence[str]]) -> dict[str, str]:
    return {n: layouts[0] for n, layouts in fitting_layouts(found, candidates).items()}


def by_kind(types: list[ColumnType]) -> dict[str, list[str]]:
    """Column names by report group; booleans are listed with the texts."""
    return {
        "numeric": [t.column for t in types if t.is_numeric],
        "date": [t.column for t in types if t.is_date],
        "categorical": [t.column for t in types if t.is_categorical],
        "text": [t.column for t in types if not (t.is_numeric or t.is_date or t.is_categorical)],
    }
