"""Delimited-text scan with typed columns."""

from __future__ import annotations

import csv as csvlib
import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce
from operator import or_
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tabulens.functions.columns import POSITION, chunks, col, data_columns, data_fields
from tabulens.functions.scalars import NA_TOKENS, normalise_missing
from tabulens.sources.splits import Quotes, cut, fragments, joined_pieces, summed_up

# Separators, and texts read as booleans and as numbers.
USUAL_SEPARATORS = (",", ";", "\t", "|")
BYTE_ORDER_MARK = "\ufeff"
TRUE_TEXTS = ("True", "TRUE", "true")
FALSE_TEXTS = ("False", "FALSE", "false")
INTEGER_TEXT = r"^\s*[+-]?\d+\s*$"
DECIMAL_TEXT = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"

#: Columns typed per aggregate, to keep generated code small.
_COLUMNS_PER_PASS = 64


@dataclass(frozen=True)
class Header:
    """First record of a delimited file: separator, raw names and unique names."""

    separator: str
    raw: tuple[str, ...]
    names: tuple[str, ...]


@dataclass(frozen=True)
class _Files:
    """Files with the same first record, all or none of which have values that span lines."""

    paths: tuple[str, ...]
    separator: str
    raw: tuple[str, ...]
    multiline: bool


def read_header(spark: SparkSession, path: str, separator: str | None = None) -> Header:
    """Look at the first record of the first file only; sniff the separator unless it is given."""
    lines = _filled_lines(spark, path)
    first = lines.agg(F.min("file")).first()[0]
    if first is None:
        raise ValueError(f"no data in {path}")
    separator, raw = _read_first_record(spark, first, separator)
    return Header(separator, raw, _unique_names(raw))


def _filled_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Physical lines that are not blank, with their file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return lines.where(F.trim("value") != "")


def _exactly(file: str) -> str:
    """The path behind a file's address, without signs that stand for others."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", unquote(file))


def _first_record(lines: list[str], separator: str) -> tuple[tuple[str, ...], bool]:
    """Fields of the first record, and whether it ends within the lines."""
    used_up = []

    def feed():
        for line in lines:
            yield line + "\n"
        used_up.append(True)

    fields = tuple(next(csvlib.reader(feed(), delimiter=separator)))
    return fields, not used_up


def _split_header(lines: list[str], separator: str | None) -> tuple[str, tuple[str, ...], bool]:
    lines = [lines[0].lstrip(BYTE_ORDER_MARK), *lines[1:]]
    separator = separator or _sniff(lines)
    return separator, *_first_record(lines, separator)


def _read_first_record(spark: SparkSession, file: str, separator: str | None) -> tuple[str, tuple[str, ...]]:
    """Read one file's lines, twice as many each time, until its first record is whole."""
    wanted = 1
    try:
        while True:
            lines = [row["value"] for row in _filled_lines(spark, _exactly(file)).head(wanted)]
            separator_found, fields, whole = _split_header(lines, separator)
            if whole or len(lines) < wanted:
                return separator_found, fields
            wanted *= 2
    except csvlib.Error as error:
        raise ValueError(f"no header in {file}: {error}") from error


def _file_groups(
    spark: SparkSession, path: str, separator: str | None, multiline: bool | None
) -> list[_Files]:
    """Files by first record and by whether a value spans lines, in the order of their paths.

    One scan of the text finds the first line of every file and the files in
    which some line leaves a quote open.  Only a first record that spans lines
    needs another look, a small job per file.  Apart from headers, the driver
    gets the paths, which Spark's own file listing holds there anyway.
    """
    quotes = F.length("value") - F.length(F.translate("value", '"', ""))
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
        ).alias("place"),
    )
    per_file = (
        lines.where(F.trim("value") != "")
        .groupBy("file")
        .agg(F.min_by("value", "place").alias("first"), F.bool_or(quotes % 2 == 1).alias("open"))
    )
    found: dict[tuple, list[str]] = {}
    for row in per_file.groupBy("first", "open").agg(F.collect_list("file").alias("files")).collect():
        spans = row["open"] if multiline is None else multiline
        sep, raw, whole = _split_header([row["first"]], separator)
        if whole:
            found.setdefault((sep, raw, spans), []).extend(row["files"])
            continue
        for file in row["files"]:
            found.setdefault((*_read_first_record(spark, file, separator), spans), []).append(file)
    if not found:
        raise ValueError(f"no data in {path}")
    groups = [_Files(tuple(sorted(files)), *key) for key, files in found.items()]
    return sorted(groups, key=lambda group: group.paths[0])


def _numbered(raw: tuple[str, ...]) -> list[tuple[str, int]]:
    """Each name with the number of times that it came before."""
    seen: Counter[str] = Counter()
    numbered = []
    for name in raw:
        numbered.append((name, seen[name]))
        seen[name] += 1
    return numbered


def _common_names(groups: list[_Files]) -> dict[tuple[str, int], str]:
    """Unique names for all columns of all files: the first file's, then those that others add."""
    columns = list(dict.fromkeys(key for group in groups for key in _numbered(group.raw)))
    return dict(zip(columns, _unique_names(tuple(name for name, _ in columns))))


def _sniff(lines: list[str]) -> str:
    """The usual separator that makes most fields, else any other the text suggests."""
    fields = {c: len(_first_record(lines, c)[0]) for c in USUAL_SEPARATORS}
    best = max(USUAL_SEPARATORS, key=fields.get)
    if fields[best] > 1:
        return best
    try:
        other = csvlib.Sniffer().sniff("\n".join(lines)).delimiter
    except csvlib.Error:
        return ","
    return "," if other.isalnum() or other in "_\"'\n" else other


def _unique_names(raw: tuple[str, ...]) -> tuple[str, ...]:
    """Blank names become ``Unnamed: i``; the n-th repeat of ``a`` becomes ``a.n``.

    Names that differ only in case count as repeats, since Spark would not
    tell them apart.
    """
    taken: set[str] = {name.lower() for name in raw}
    seen: dict[str, int] = {}
    names = []
    for i, name in enumerate(raw):
        name = name or f"Unnamed: {i}"
        key = name.lower()
        if key in seen:
            repeat = seen[key] + 1
            while f"{key}.{repeat}" in taken:
                repeat += 1
            seen[key] = repeat
            name = f"{name}.{repeat}"
            taken.add(name.lower())
        else:
            seen[key] = 0
        names.append(name)
    return tuple(names)


def with_position(df: DataFrame) -> DataFrame:
    """Attach the ingestion position; must be applied to a scan, before any shuffle.

    Rows compare by file, then by split, then by place in the split.  Tables
    that do not come from files compare by partition.
    """
    row = F.monotonically_increasing_id()
    try:
        return df.select(
            "*",
            F.struct(
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"),
                row.alias("row"),
            ).alias(POSITION),
        )
    except AnalysisException:
        return df.select(
            "*",
            F.struct(
                F.lit("").alias("file"), F.lit(0).cast("bigint").alias("block"), row.alias("row")
            ).alias(POSITION),
        )


def read_text_columns(
    spark: SparkSession,
    path: str,
    separator: str | None = None,
    multiline: bool | None = None,
    position: bool = True,
) -> DataFrame:
    """Every column as a string, missing-value tokens as NULL.

    Files are matched by the names in their own headers, exactly as written; a
    column that a file lacks is NULL there.  ``multiline=None`` finds out in
    which files a quoted value may span lines; their records are cut first (see
    ``splits``), since a split of such a file may start inside a value.
    """
    groups = _file_groups(spark, path, separator, multiline)
    names = _common_names(groups)
    whole = len(groups) == 1
    scans = [
        _scan(spark, path if whole else [_exactly(p) for p in group.paths], group, names, position)
        for group in groups
    ]
    return reduce(DataFrame.unionAll, scans)


def _scan(
    spark: SparkSession,
    path: str | list[str],
    group: _Files,
    names: dict[tuple[str, int], str],
    position: bool,
) -> DataFrame:
    own = [names[key] for key in _numbered(group.raw)]
    options = {"sep": group.separator, "escape": '"', "nullValue": "", "emptyValue": ""}
    if group.multiline:
        scan = _spanning_records(spark, path, own, options, position)
    else:
        schema = T.StructType([T.StructField(n, T.StringType()) for n in own])
        scan = spark.read.csv(path, schema=schema, header=True, enforceSchema=True, **options)
        if position:
            scan = with_position(scan)
    present = set(own)
    return scan.select(
        *[
            (F.when(~col(n).isin(*NA_TOKENS), col(n)) if n in present else F.lit(None).cast("string")).alias(n)
            for n in names.values()
        ],
        *([POSITION] if position else []),
    )


def _spanning_records(
    spark: SparkSession, path: str | list[str], names: list[str], options: dict[str, str], position: bool
) -> DataFrame:
    """Records of files whose quoted values may span lines, without headers; every split is read by a task of its own."""
    lines, quotes = fragments(spark, path, "\n"), Quotes(options["sep"])
    found = cut(lines, quotes.states(summed_up(lines, quotes.summarise)), quotes.cut)
    place = ["file", "block", "row"]
    records = found.filter("part IS NULL").select(*place, "value")
    records = records.unionByName(joined_pieces(found.filter("part IS NOT NULL")).select(*place, "value"))
    # Names may have any sign, so the parser gets plain ones.
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    parsed = F.from_csv("value", schema, {**options, "multiLine": "true"})
    # The first record of a file is its header.
    records = records.filter("block > 0 OR row > 0").select(parsed.alias("record"), F.struct(*place).alias(POSITION))
    return records.select(
        *[F.col(f"record.c{i}").alias(n) for i, n in enumerate(names)], *([POSITION] if position else [])
    )


def _text_counts(names: list[str]) -> list[Column]:
    counts = []
    for i, name in enumerate(names):
        value = col(name)
        counts += [
            F.count(value).alias(f"present{i}"),
            F.count_if(value.rlike(INTEGER_TEXT) & F.trim(value).try_cast("bigint").isNotNull()).alias(
                f"integer{i}"
            ),
            F.count_if(value.rlike(DECIMAL_TEXT)).alias(f"decimal{i}"),
            F.count_if(value.isin(*TRUE_TEXTS, *FALSE_TEXTS)).alias(f"boolean{i}"),
        ]
    return counts


def _typed(name: str, rows: int, present: int, integer: int, decimal: int, boolean: int) -> Column:
    value = col(name)
    if present == 0:
        return value
    if boolean == present:
        return value.isin(*TRUE_TEXTS)
    if integer == present and present == rows:
        return F.trim(value).try_cast("bigint")
    if decimal == present:
        return F.trim(value).try_cast("double")
    return value


def infer_types(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Give string columns the narrowest of bigint, double, boolean that fits all values.

    Counts per column come from one scan.  An integer column with gaps becomes
    double; texts such as ``1d`` or ``yes`` stay strings.  Also returns the
    columns without any value.
    """
    names = [f.name for f in data_fields(df) if isinstance(f.dataType, T.StringType)]
    typed: dict[str, Column] = {}
    empty: list[str] = []
    for group in chunks(names, _COLUMNS_PER_PASS):
        counts = df.agg(F.count(F.lit(1)).alias("rows"), *_text_counts(list(group))).first()
        for i, name in enumerate(group):
            kinds = [counts[f"{k}{i}"] for k in ("present", "integer", "decimal", "boolean")]
            typed[name] = _typed(name, counts["rows"], *kinds)
            if kinds[0] == 0:
                empty.append(name)
    return df.select(*[typed.get(n, col(n)).alias(n) for n in df.columns]), empty


def _drop_empty_rows(df: DataFrame) -> DataFrame:
    filled = [col(n).isNotNull() for n in data_columns(df)]
    return df.where(reduce(or_, filled)) if filled else df.limit(0)


def drop_empty(df: DataFrame) -> DataFrame:
    """Remove all-empty rows, then all-empty columns."""
    df = normalise_missing(df)
    names = data_columns(df)
    present = df.agg(*[F.count(col(n)).alias(f"c{i}") for i, n in enumerate(names)]).first()
    keep = {n for i, n in enumerate(names) if present[f"c{i}"] > 0}
    return _drop_empty_rows(df.select(*[col(n) for n in df.columns if n in keep or n == POSITION]))


def read_csv(
    spark: SparkSession,
    path: str,
    separator: str | None = None,
    multiline: bool | None = None,
    position: bool = True,
) -> DataFrame:
    """Typed table from delimited files, without empty rows and columns."""
    text = read_text_columns(spark, path, separator, multiline, position)
    typed, empty = infer_types(text)
    return _drop_empty_rows(typed.select(*[col(n) for n in typed.columns if n not in empty]))


def format_of(path: str, fmt: str | None = None) -> str:
    """The given format, or the one the extension names."""
    return fmt or path.rstrip("/").rsplit(".", 1)[-1].lower()


def read_table(spark: SparkSession, path: str, fmt: str | None = None, position: bool = True) -> DataFrame:
    """Scan ``.csv``, ``.parquet`` or line-wise ``.json`` without empty rows and columns."""
    kind = format_of(path, fmt)
    if kind == "csv":
        return read_csv(spark, path, position=position)
    if kind not in ("parquet", "json"):
        raise ValueError(f"unsupported format: {kind}")
    scan = spark.read.format(kind).load(path)
    return drop_empty(with_position(scan) if position else scan)
