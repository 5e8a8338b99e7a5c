"""Admission audit over a folder of files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What an upload may be.
UPLOAD_EXTENSIONS = (".xlsx", ".xls", ".csv")
MAX_UPLOAD_BYTES = 10 * 1024 * 1024

#: What Spark itself can scan here.
SCAN_EXTENSIONS = (".csv", ".parquet", ".json")


def audit_files(
    spark: SparkSession,
    path: str,
    extensions: Iterable[str] = SCAN_EXTENSIONS,
    max_bytes: int | None = None,
) -> DataFrame:
    """One row per file: ``file_name, extension, size, known_extension, within_size, admitted``.

    Only path and length are selected, so no file content is read.  A file of
    exactly ``max_bytes`` is still admitted.  There is no size rule by default;
    ``MAX_UPLOAD_BYTES`` is the one for uploads.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", F.col("length").alias("size"))
    )
    name = F.element_at(F.split("path", "/"), -1)
    return (
        files.withColumn("file_name", name)
        .withColumn("extension", F.lower(F.regexp_extract("file_name", r"[^.].*(\.[^.]+)$", 1)))
        .withColumn("known_extension", F.col("extension").isin([e.lower() for e in extensions]))
        .withColumn("within_size", F.lit(True) if max_bytes is None else F.col("size") <= max_bytes)
        .withColumn("admitted", F.col("known_extension") & F.col("within_size"))
        .select("file_name", "extension", "size", "known_extension", "within_size", "admitted")
    )
