"""File in, cleaned and described dataset out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tabulens.functions.columns import data_fields
from tabulens.functions.storage import new_folder, remove
from tabulens.operators.clean import Cleaned, clean_table
from tabulens.operators.profile import sample_rows, sample_stats
from tabulens.plans.report import Described, describe, describe_from, position_of
from tabulens.sources.csv import format_of, read_table
from tabulens.sources.documents import load_dataset, save_dataset


@dataclass
class Ingested:
    path: str | None
    cleaned: Cleaned
    described: Described
    sample: DataFrame
    sample_stats: DataFrame
    staged: list[str] = field(default_factory=list)

    def release(self) -> None:
        """Remove the copy that ``frame`` and everything not yet computed read; what is stored stays."""
        for folder in self.staged:
            remove(self.described.spark, folder)
        self.staged.clear()

    @property
    def frame(self) -> DataFrame:
        return self.cleaned.frame


def ingest(
    spark: SparkSession,
    source: str | DataFrame,
    path: str | None = None,
    fmt: str | None = None,
    store_format: str = "parquet",
    infer_strings: bool = True,
    approx: bool = False,
) -> Ingested:
    """Scan, clean, describe and, with ``path``, store a table.

    Text files are parsed once into a Parquet copy in the shared folder; all
    later scans read single columns of that copy, until ``release`` removes it.
    """
    staged: list[str] = []
    if isinstance(source, str):
        raw = read_table(spark, source, fmt)
        if format_of(source, fmt) != "parquet":
            staged.append(new_folder(spark, "staged"))
            raw.write.parquet(staged[0])
            raw = spark.read.parquet(staged[0])
    else:
        raw = source
    cleaned = clean_table(raw)
    described = describe(cleaned.frame, infer_strings, cleaned.had_gaps, approx)
    if path:
        save_dataset(cleaned.frame, {**described.metadata(), "state": described.state}, cleaned.as_dict(), path, store_format)
    sample = sample_rows(cleaned.frame, position_of(cleaned.frame, None))
    return Ingested(path, cleaned, described, sample, sample_stats(described.profile), staged)


def open_dataset(spark: SparkSession, path: str, infer_strings: bool = True) -> tuple[DataFrame, Described]:
    """A stored dataset, with its positions, and its description for ``auto_report`` or ``analyze``.

    The state that ``ingest`` stored with it makes types, choices and charts known
    without a scan.  A dataset without one, or whose columns have other types as it
    is stored (dates in JSON lines), is described anew.
    """
    frame, meta = load_dataset(spark, path, position=True)
    state = meta.get("state")
    kinds = {f.name: f.dataType.simpleString() for f in data_fields(frame)}
    if not state or {n: c["dtype"] for n, c in state["columns"].items()} != kinds:
        return frame, describe(frame, infer_strings)
    gaps = [n for n, t in meta["column_types"].items() if t["semantic_type"] == "float" and kinds[n] in ("bigint", "int")]
    return frame, describe_from(frame, state, infer_strings, gaps)
