"""Column references and type predicates."""

from __future__ import annotations

from collections.abc import Hashable, Iterator, Mapping, Sequence
from typing import Any, TypeVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Aggregates per scan, to keep generated code small.
_AGGREGATES_AT_ONCE = 256

#: A table of more bytes, as Spark estimates it without a job, is worth a look before a shuffle.
LARGE_BYTES = 10 << 30

_Key = TypeVar("_Key", bound=Hashable)

#: Name of the ingestion position column that scans may attach (see ``sources.csv``).
POSITION = "__position"

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def col(name: str) -> Column:
    """Reference a column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_integral(dtype: T.DataType) -> bool:
    return isinstance(dtype, INTEGRAL)


def is_fractional(dtype: T.DataType) -> bool:
    return isinstance(dtype, FRACTIONAL)


def is_numeric(dtype: T.DataType) -> bool:
    return is_integral(dtype) or is_fractional(dtype)


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, TEMPORAL)


def is_boolean(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.BooleanType)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StringType)


def is_summable(dtype: T.DataType) -> bool:
    """Numbers and booleans can be summed and averaged; nothing else can."""
    return is_numeric(dtype) or is_boolean(dtype)


def data_fields(df: DataFrame) -> list[T.StructField]:
    """The table's own fields, without the ingestion position."""
    return [f for f in df.schema.fields if f.name != POSITION]


def data_columns(df: DataFrame) -> list[str]:
    return [f.name for f in data_fields(df)]


def field_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def chunks(items: Sequence, size: int) -> Iterator[Sequence]:
    for start in range(0, len(items), size):
        yield items[start : start + size]


def aggregated(df: DataFrame, wanted: Mapping[_Key, Column]) -> dict[_Key, Any]:
    """The value of every aggregate, all from one scan unless there are very many."""
    found: dict[_Key, Any] = {}
    for group in chunks(list(wanted.items()), _AGGREGATES_AT_ONCE):
        row = df.agg(*[value.alias(f"a{i}") for i, (_, value) in enumerate(group)]).collect()[0]
        found |= {key: row[i] for i, (key, _) in enumerate(group)}
    return found


def is_large(df: DataFrame) -> bool:
    """Whether Spark's own size estimate, made without a job, is above ``LARGE_BYTES``.

    Only ways to the same result hang on it.  A table without an estimate, such as
    rows of the driver, counts as endless in Spark, and as small here.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return LARGE_BYTES < size < 1 << 56
