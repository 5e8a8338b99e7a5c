"""Stored datasets and results: Parquet or JSON lines plus a small metadata file."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tabulens.functions.columns import POSITION, col, data_columns, data_fields, is_temporal
from tabulens.functions.scalars import iso_text, normalise_missing
from tabulens.functions.storage import new_folder, stage
from tabulens.sources.csv import with_position
from tabulens.sources.splits import Documents, cut, fragments, joined_pieces, summed_up

_PIECE = "file string, block long, row long, part long, kind string, value string"


def save_dataset(
    df: DataFrame,
    metadata: dict[str, Any],
    cleaning: dict[str, Any],
    path: str,
    fmt: str = "parquet",
) -> str:
    """Write ``<path>/data`` and a one-line ``<path>/meta``; rows stay on the executors.

    An earlier dataset at the path is replaced.  The JSON form holds timestamps
    as ISO text, the Parquet form keeps types.
    """
    rows = normalise_missing(df.select(*[col(n) for n in data_columns(df)]))
    if fmt == "json":
        rows = rows.select(
            *[
                (iso_text(col(f.name), f.dataType) if is_temporal(f.dataType) else col(f.name)).alias(f.name)
                for f in data_fields(rows)
            ]
        )
    rows.write.mode("overwrite").option("ignoreNullFields", "false").format(fmt).save(f"{path}/data")
    created = datetime.now(timezone.utc).replace(tzinfo=None).isoformat() + "Z"
    meta = {**metadata, "cleaning_report": cleaning, "format": fmt, "created_at": created}
    spark = df.sparkSession
    line = spark.createDataFrame([(json.dumps(meta, ensure_ascii=False, default=str),)], "value string")
    line.coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    return path


def load_dataset(
    spark: SparkSession, path: str, position: bool = False
) -> tuple[DataFrame, dict[str, Any]]:
    """Read back a stored dataset, or a JSON document ``{_meta, data[]}`` or ``[...]``.

    ``position`` attaches the place of each row in the stored files.
    """
    if path.rstrip("/").endswith(".json"):
        return load_document(spark, path, position)
    try:
        meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
        rows = spark.read.format(meta["format"]).load(f"{path}/data")
        rows = with_position(rows) if position else rows
    except AnalysisException as error:
        raise FileNotFoundError(f"no dataset at {path}") from error
    return _in_order(rows, meta), meta


def load_document(spark: SparkSession, path: str, position: bool = False) -> tuple[DataFrame, dict[str, Any]]:
    """Read JSON documents ``{_meta, data[]}`` or ``[...]``; a bare list of records has no metadata.

    A document of any size is cut into records by as many tasks as its file has
    splits (see ``splits``), whatever its line breaks, and rewritten as JSON
    lines in the shared folder, which Spark splits by itself from then on.
    ``position`` attaches the place of each record in its document. A document
    that is neither form is one row.
    """
    try:
        texts = fragments(spark, path, Documents.separator)
        files = summed_up(texts, Documents.summarise)
    except AnalysisException as error:
        raise FileNotFoundError(f"no dataset at {path}") from error
    if not Documents.hold_records(files):
        rows = spark.read.json(path, multiLine=True)
        return (rows.withColumn(POSITION, F.monotonically_increasing_id()) if position else rows), {}
    states = Documents.states(files)
    folder = new_folder(spark, "records")
    found = cut(texts, states, Documents.cut)
    other = F.col("part").isNotNull() | (F.col("kind") != "row")
    aside = F.concat(F.lit('{"aside":'), F.to_json(F.struct(*found.columns)), F.lit("}"))
    found.select(F.when(other, aside).otherwise(_record_line(position)).alias("value")).write.text(f"{folder}/whole")
    folders = [f"{folder}/whole"]

    # Pieces of records that span splits, and the metadata: a few rows per split, found in one scan.
    apart = spark.read.text(folders).filter(F.col("value").startswith('{"aside":'))
    apart = apart.select(F.from_json("value", f"aside struct<{_PIECE}>").alias("line"))
    apart = stage(apart.select("line.aside.*").filter("kind IS NOT NULL"), "apart")
    joined = joined_pieces(apart.filter("part IS NOT NULL"))
    if any(place.target and place.depth > place.target[1] for place, _ in states.values()):
        joined.filter("kind = 'row'").select(_record_line(position).alias("value")).write.text(f"{folder}/joined")
        folders.append(f"{folder}/joined")
    metas = apart.filter("part IS NULL").select("file", "value").unionByName(joined.filter("kind = 'meta'").select("file", "value"))
    first = metas.orderBy("file").first()
    meta = json.loads(first["value"]) if first else {}

    lines = spark.read.json(folders)
    if "_corrupt_record" in lines.columns:
        raise ValueError(f"{path} has records that are no JSON")
    if "value" not in lines.columns:
        fields = [T.StructField(n, T.StringType()) for n in meta.get("columns", [])]
        return spark.createDataFrame([], T.StructType(fields)), meta
    place = [F.struct("at.file", "at.block", "at.row").alias(POSITION)] if position else []
    return _in_order(lines.filter("value IS NOT NULL").select("value.*", *place), meta), meta


def _record_line(position: bool) -> Column:
    """A record, and its place if that is wanted, as one line; a line break in JSON text is white space."""
    place = [F.lit('"at":'), F.to_json(F.struct("file", "block", "row")), F.lit(",")] if position else []
    return F.concat(F.lit("{"), *place, F.lit('"value":'), F.translate("value", "\n\r", "  "), F.lit("}"))


def _in_order(rows: DataFrame, meta: dict[str, Any]) -> DataFrame:
    """JSON readers sort fields by name; the metadata knows the real order."""
    known = [n for n in meta.get("columns", []) if n in rows.columns]
    return rows.select(*[col(n) for n in known + [n for n in rows.columns if n not in known]])


def save_results(tables: dict[str, DataFrame], dataset_id: str, path: str) -> str:
    """Write result tables below ``path``, one folder each, replacing the dataset's partition."""
    for name, table in tables.items():
        tagged = table.withColumn("dataset_id", F.lit(dataset_id))
        writer = tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("dataset_id").parquet(f"{path}/{name}")
    return path


def load_results(spark: SparkSession, path: str, name: str, dataset_id: str) -> DataFrame:
    """Result rows of one dataset; only its partition is read."""
    found = spark.read.parquet(f"{path}/{name}").drop("dataset_id").schema
    # Without a schema an identifier such as 007 would be read as a number.
    schema = T.StructType([*found.fields, T.StructField("dataset_id", T.StringType())])
    return spark.read.schema(schema).parquet(f"{path}/{name}").where(F.col("dataset_id") == dataset_id)
