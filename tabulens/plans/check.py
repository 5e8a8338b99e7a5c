"""Structural validation of a delimited file."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from tabulens.operators.validate import Validation, validate_table
from tabulens.sources.csv import format_of, read_header, read_text_columns


def validate_file(spark: SparkSession, path: str, fmt: str | None = None) -> Validation:
    """Check a CSV file or folder as it stands: nothing is dropped or typed before.

    The format is the one given or the one that the extension names.  Names are
    checked in the first record itself, so that repeats are seen
    although columns get unique names.  A file that cannot be read is invalid.
    """
    failed = Validation()
    if format_of(path, fmt) != "csv":
        failed.note("unsupported_format", "error", 0, path)
        return failed
    try:
        header = read_header(spark, path)
        table = read_text_columns(spark, path, header.separator)
        return validate_table(table, header=header.raw)
    except (PySparkException, ValueError) as error:
        failed.note("unreadable", "error", 0, str(error))
        return failed
