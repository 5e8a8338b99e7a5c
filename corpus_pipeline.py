"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabulens.llm import exact, near, packing, quality, substrings
from tabulens.llm.shared import run_stages, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: All but the last return the columns of `documents`.
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality.quality_stage),
    ("exact_dedup", exact.exact_stage),
    ("near_dedup", near.near_stage),
    ("substring_dedup", substrings.substring_stage),
    ("best_fit_packing", packing.packing_stage),
]

#: Tokenizing and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that the stages keep."""
    return run_stages(spark, table(spark, sf_dir, "documents"), sf_dir, STAGES)
