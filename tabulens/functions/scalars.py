"""Scalar and aggregate expressions shared by the operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens.functions.columns import (
    col,
    is_boolean,
    is_fractional,
    is_integral,
    is_temporal,
)

# Cell texts that mean "missing" in a delimited file.
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Name fragments of columns that look like identifiers.
ID_FRAGMENTS = ("id", "index", "num", "numero")

# Date layouts by the shape of a text, where 9 stands for digits
# and a for letters.  The first layout that fits a whole column counts, so
# month-first comes before day-first.
DATE_SHAPES = {
    "9-9-9": ("yyyy-M-d", "M-d-yyyy", "d-M-yyyy"),
    "9/9/9": ("M/d/yyyy", "d/M/yyyy", "yyyy/M/d"),
    "9.9.9": ("M.d.yyyy", "d.M.yyyy", "yyyy.M.d"),
    "a 9, 9": ("MMM d, yyyy", "MMMM d, yyyy"),
    "9 a 9": ("d MMM yyyy", "d MMMM yyyy"),
    "9-a-9": ("d-MMM-yyyy",),
    "9-9": ("yyyy-M",),
    "9/9": ("M/yyyy",),
    "9": ("yyyyMMdd", "yyyy"),
}
# Times that may follow a date.
TIME_SHAPES = {
    "9:9": "H:mm",
    "9:9:9": "H:mm:ss",
    "9:9:9.9": "H:mm:ss.SSSSSS",
    "9:9 a": "h:mm a",
    "9:9:9 a": "h:mm:ss a",
    "9:9:9a": "H:mm:ssXXX",
    "9:9:9+9:9": "H:mm:ssXXX",
    "9:9:9-9:9": "H:mm:ssXXX",
    "9:9:9.9a": "H:mm:ss.SSSSSSXXX",
}
# First and last second that count as a date in a text.
EARLIEST, LATEST = "1677-09-21 00:12:44", "2262-04-11 23:47:16"
_LONGEST_DATE = 40


def date_shape(value: Column) -> Column:
    """Shape of a text, empty for one too long to be a date or without a digit."""
    digits = F.regexp_replace(value, "[0-9]+", "9")
    short = (F.length(value) <= _LONGEST_DATE) & value.rlike("[0-9]")
    return F.when(short, F.regexp_replace(digits, "[A-Za-z]+", "a")).when(value.isNotNull(), "")


def layouts_of(shape: str | None) -> tuple[str, ...]:
    """Layouts that a text of this shape may follow."""
    for date, days in DATE_SHAPES.items():
        if shape == date:
            return days
        for time, clock in TIME_SHAPES.items():
            if shape == f"{date} {time}":
                return tuple(f"{day} {clock}" for day in days)
            if shape == f"{date}a{time}":
                return tuple(f"{day}'T'{clock}" for day in days)
    return ()


def _may_be_nan(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def nan_to_null(value: Column, dtype: T.DataType) -> Column:
    """One notion of "missing": NaN becomes NULL, other values are untouched."""
    return F.when(~F.isnan(value), value) if _may_be_nan(dtype) else value


def is_missing(value: Column, dtype: T.DataType) -> Column:
    return value.isNull() | F.isnan(value) if _may_be_nan(dtype) else value.isNull()


def normalise_missing(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating-point column."""
    if not any(_may_be_nan(f.dataType) for f in df.schema.fields):
        return df
    return df.select(
        *[nan_to_null(col(f.name), f.dataType).alias(f.name) for f in df.schema.fields]
    )


def exact_round(value: Column, digits: int) -> Column:
    """Round half-to-even on the exact binary value of a double.

    ``F.round`` and ``F.bround`` work on the shortest decimal text instead, so
    21816.12875 would become .1288 rather than .1287.  The value goes through
    text, so use this on small results only.  Infinities stay as they are.
    """
    text = F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))
    return F.coalesce(text.try_cast("double"), value)


def total(value: Column, dtype: T.DataType) -> Column:
    """Sum as a double; NULL when every value is missing.

    Integers are summed exactly while the total fits 64 bits.
    """
    if is_integral(dtype):
        return F.coalesce(F.try_sum(value).cast("double"), F.sum(value.cast("double")))
    if is_boolean(dtype):
        return F.sum(value.cast("int")).cast("double")
    return F.sum(value.cast("double"))


def average(value: Column, dtype: T.DataType) -> Column:
    if is_boolean(dtype):
        value = value.cast("int")
    return F.avg(value.cast("double"))


def as_number(value: Column, dtype: T.DataType) -> Column:
    if is_boolean(dtype):
        value = value.cast("int")
    return value.cast("double")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, NULL for a zero denominator."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    return ratio(part, whole) * 100


def variation(std: Column, mean: Column) -> Column:
    """Signed coefficient of variation; 0 for a missing or zero mean."""
    return F.coalesce(ratio(std, mean), F.lit(0.0))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over complete pairs; NULL when a side is constant."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def iso_text(value: Column, dtype: T.DataType) -> Column:
    """ISO-8601 text; microseconds only when there are any."""
    if isinstance(dtype, T.DateType):
        value = value.cast("timestamp_ntz")
    text = F.translate(value.cast("string"), " ", "T")
    return F.when(text.contains("."), F.rpad(text, 26, "0")).otherwise(text)


def float_text(value: Column) -> Column:
    """Text of a double with plain digits between 1e-4 and 1e16."""
    value = value.cast("double")
    text = value.cast("string")
    plain = F.regexp_replace(
        F.when(F.abs(value).between(1e-4, 9.999999999999998e15), text.try_cast("decimal(38,21)")).cast(
            "string"
        ),
        r"(\.\d+?)0*$",
        "$1",
    )
    mantissa = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    power = F.substring_index(text, "E", -1).try_cast("int")
    exponent = F.format_string(
        "%se%s%02d", mantissa, F.when(power < 0, "-").otherwise("+"), F.abs(power)
    )
    return F.when(~text.contains("E"), F.when(F.isnan(value), "nan").otherwise(text)).otherwise(
        F.coalesce(plain, exponent)
    )


def label_text(value: Column, dtype: T.DataType) -> Column:
    """Display label of a value."""
    if is_boolean(dtype):
        return F.when(value, "True").when(~value, "False")
    if is_temporal(dtype):
        return iso_text(value, dtype)
    if is_fractional(dtype):
        return float_text(value)
    return value.cast("string")


def looks_like_id(name: Column) -> Column:
    return F.lower(name).rlike("|".join(ID_FRAGMENTS))


def parse_timestamp(value: Column, fmt: str) -> Column:
    """Timestamp for texts that follow ``fmt`` completely, NULL otherwise.

    Texts with an offset are converted to the session time zone.  Others mean
    what they say in any zone: they are read as UTC and counted from its epoch,
    so an hour that the session's zone leaves out in spring stays as it is.
    """
    if re.search("[XxZzVO]", re.sub("'[^']*'", "", fmt)):
        moment = F.try_to_timestamp(value, F.lit(fmt)).cast("timestamp_ntz")
    else:
        instant = F.try_to_timestamp(F.concat(value, F.lit(" +00:00")), F.lit(f"{fmt} XXX"))
        seconds = (F.unix_micros(instant).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
        moment = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)
    bounds = [F.lit(edge).cast("timestamp_ntz") for edge in (EARLIEST, LATEST)]
    return F.when(moment.between(*bounds), moment)
