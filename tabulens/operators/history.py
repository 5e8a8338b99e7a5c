"""Queries over the table of past runs.

Runs have the columns ``id, user_id, file_name, file_size, file_path, status,
results, tokens_consumed, created_at``; a query needs only those it names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Billing unit in bytes, and the part of a result that is read.
BYTES_PER_TOKEN = 10 * 1024
RESULT_SCHEMA = (
    "metadata struct<columns: array<string>, "
    "column_types: map<string, struct<semantic_type: string>>>"
)


def run_cost(size: Column) -> Column:
    """Tokens for a file: one per started 10 KiB, at least one.

    Integer arithmetic, so a file of exactly 10 KiB costs 1 and one byte more costs 2.
    """
    units = F.floor((F.coalesce(size, F.lit(0)).cast("bigint") + (BYTES_PER_TOKEN - 1)) / BYTES_PER_TOKEN)
    return F.greatest(units, F.lit(1)).cast("bigint")


def runs_newest_first(runs: DataFrame, user_id=None) -> DataFrame:
    """Runs of one user, newest first; of every user if none is given.

    All users together are sorted by user and time, so that a user with very
    many runs is spread over several partitions.
    """
    if user_id is not None:
        runs = runs.where(F.col("user_id") == F.lit(user_id))
    return runs.orderBy("user_id", F.desc("created_at"), F.desc("id")).select(
        "user_id", "id", "file_name", "status", "tokens_consumed", "created_at"
    )


def latest_completed(runs: DataFrame) -> DataFrame:
    """Newest COMPLETED run per user, with the columns and types its result lists."""
    newest = F.max_by(
        F.struct("id", "file_name", "created_at", "results"), F.struct("created_at", "id")
    ).alias("run")
    latest = runs.where(F.col("status") == "COMPLETED").groupBy("user_id").agg(newest)
    metadata = F.from_json("run.results", RESULT_SCHEMA)["metadata"]
    return latest.select(
        "user_id",
        "run.id",
        "run.file_name",
        "run.created_at",
        metadata["columns"].alias("columns"),
        F.transform_values(
            metadata["column_types"], lambda _, v: F.coalesce(v["semantic_type"], F.lit("text"))
        ).alias("column_types"),
    )


def dataset_id(path: Column) -> Column:
    """File name without ``.json``; empty for a run without a file."""
    name = F.replace(F.element_at(F.split(path, "/"), -1), F.lit(".json"), F.lit(""))
    return F.coalesce(name, F.lit(""))


def find_run(runs: DataFrame, run_id, user_id) -> DataFrame:
    """The run with this id, if it belongs to the user."""
    mine = runs.where((F.col("id") == F.lit(run_id)) & (F.col("user_id") == F.lit(user_id)))
    return mine.withColumn("dataset_id", dataset_id(F.col("file_path")))
