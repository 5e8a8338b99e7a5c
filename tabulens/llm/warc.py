"""WARC archives: writing with revisit records, and a reader that salvages.

The writer makes one record per row; Spark's text sink with the record end as
its line separator writes valid uncompressed WARC files wherever Spark can write,
with its commit protocol. Of long equal payloads one is a response, the others
are revisits that refer to it.

The reader checks every record: version line, header block, Content-Length, the
end of record, payload digest. After a failed check it searches for the next
version line (or the next valid gzip member in compressed archives), goes on
from there, and reports the bytes between as a quarantined gap. It feeds a
decompressor blocks and counts what it took, and checks headers line by line, so
its time grows in proportion to an archive's size.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulens.functions.storage import new_folder, stage
from tabulens.llm.shared import bounded_batches

VERSION = "WARC/1.1"
END = "\r\n\r\n"
LEAST_REVISIT = 1000
#: An archive has at most so many records, and fewer if they are long: about so many bytes.
RECORDS_PER_FILE = 2000
FILE_BYTES = 128 << 20
#: Records up to so many bytes are written together; beyond, lengths within a factor of `CLASS` are.
SHORT = FILE_BYTES // RECORDS_PER_FILE
CLASS = 4
INFLATE_BYTES = 64 << 10

_VERSION_LINE = re.compile(rb"WARC/\d+\.\d+\r\n")
_MEMBER = b"\x1f\x8b\x08"

RECORD = (
    "archive string, position long, record_type string, page_id long, url string, payload_bytes long, "
    "payload_digest string, refers_to long, payload binary"
)
GAP = "archive string, position long, length long, reason string"


def with_types(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to).

    Sizes are grouped by digest before any row is joined, and only digests that
    occur twice are joined at all. Rows without an id are responses, as nothing
    could refer to them. Of repeated rows with the largest id one is the response.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    long = rows.filter((F.col("payload_bytes") >= LEAST_REVISIT) & F.col("page_id").isNotNull())
    copies = long.groupBy("payload_digest", "page_id").agg(F.count(F.lit(1)).alias("n"))
    groups = copies.groupBy(F.col("payload_digest").alias("digest")).agg(
        F.max(F.struct("page_id", "n")).alias("last"), F.sum("n").alias("size")
    )
    groups = groups.filter("size > 1").select("digest", "last.page_id", "last.n")
    # Written first: its size is known then, and pages of a few repeated digests need no shuffle.
    groups = stage(groups.withColumnsRenamed({"page_id": "last_id", "n": "last_copies"}), "repeats")
    joined = rows.join(groups, F.col("payload_digest") == F.col("digest"), "left")
    revisit = F.col("digest").isNotNull() & F.col("page_id").isNotNull()
    typed = joined.withColumn("nth", F.lit(1))
    if not groups.filter("last_copies > 1").isEmpty():
        tied = F.coalesce(revisit & (F.col("page_id") == F.col("last_id")) & (F.col("last_copies") > 1), F.lit(False))
        nth = F.row_number().over(W.partitionBy("payload_digest").orderBy("url"))
        typed = typed.filter(~tied).unionByName(joined.filter(tied).withColumn("nth", nth))
    is_revisit = revisit & ((F.col("page_id") != F.col("last_id")) | (F.col("nth") > 1))
    return typed.select(
        "page_id",
        "url",
        "payload",
        "payload_bytes",
        "payload_digest",
        F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(is_revisit, F.col("last_id")).alias("refers_to"),
    )


def _record(typed: DataFrame) -> Column:
    """A whole record without its end, as bytes that the text sink takes as they are."""
    is_revisit = F.col("record_type") == "revisit"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    optional = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    block = F.when(is_revisit, F.lit(b"")).otherwise(F.col("payload"))
    head = F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", F.col("record_type")),
        optional("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))),
        optional("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        optional("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return F.concat(F.encode(head, "utf-8"), block).cast("string")


def write_archives(pages: DataFrame, path: str, per_file: int = RECORDS_PER_FILE, file_bytes: int = FILE_BYTES) -> None:
    """Write a record per row of (page_id, url, html) below `path`, up to `per_file` and about `file_bytes` to an archive.

    Null html is an empty payload. Very long pages get archives with fewer
    records, at the least one. An empty table makes a folder without archives.
    Other columns do not matter.
    """
    typed = with_types(pages)
    short = max(1, file_bytes // per_file)
    # Classes of lengths: 0 up to `short` bytes, then one for each factor of CLASS.
    longer = F.ceil(F.log(float(CLASS), F.greatest(F.col("payload_bytes"), F.lit(1)) / F.lit(float(short))))
    kind = F.greatest(F.lit(0), longer).cast("int")
    lengths = pages.select(F.coalesce(F.octet_length("html"), F.lit(0)).cast("long").alias("payload_bytes"))
    kinds = sorted(r["kind"] for r in lengths.select(kind.alias("kind")).distinct().collect())
    for number in kinds or [0]:
        records = typed.filter(kind == number).select(_record(typed).alias("value"))
        limit = max(1, per_file // CLASS**number)
        records.write.mode("append").options(lineSep=END, maxRecordsPerFile=limit).text(path)


def _inflate(data: memoryview, start: int) -> tuple[bytes, int] | None:
    """Content and end of the gzip member at a place; None if it is damaged, cut off, or none."""
    reader, parts, at = zlib.decompressobj(31), [], start
    try:
        while not reader.eof:
            block = data[at : at + INFLATE_BYTES]
            if not len(block):
                return None
            parts.append(reader.decompress(block))
            at += len(block)
    except zlib.error:
        return None
    return b"".join(parts), at - len(reader.unused_data)


def _members(data: bytes) -> Iterator[tuple[int, int, bytes | None]]:
    """(start, end, content) of the gzip members; content is None for bytes that are none."""
    view, at = memoryview(data), 0
    while at < len(data):
        found, member = data.find(_MEMBER, at), None
        while found >= 0:
            member = _inflate(view, found)
            if member:
                break
            found = data.find(_MEMBER, found + 1)
        if member is None:
            yield at, len(data), None
            return
        if found > at:
            yield at, found, None
        yield found, member[1], member[0]
        at = member[1]


def _parse(data: bytes, at: int) -> tuple[int, dict[str, str], bytes]:
    """End, headers and block of the record at a place; ValueError says which check failed."""
    version = _VERSION_LINE.match(data, at)
    if not version:
        raise ValueError("no version line")
    headers = {}
    at = version.end()
    while (line_end := data.find(b"\r\n", at)) != at:
        name, colon, value = data[at : line_end if line_end >= 0 else len(data)].partition(b":")
        if not colon or line_end < 0:
            raise ValueError("header without end" if line_end < 0 else "header line without colon")
        headers[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
        at = line_end + 2
    length = headers.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        raise ValueError("no content length")
    start = at + 2
    end = start + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("no end of record")
    block = data[start:end]
    kind, _, digest = headers.get("warc-payload-digest", "").partition(":")
    if kind == "sha1" and headers.get("warc-type") != "revisit" and hashlib.sha1(block).hexdigest() != digest:
        raise ValueError("payload digest differs")
    return end + 4, headers, block


def salvage(data: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes, str]]:
    """(position, length, headers, block, reason) of what an archive holds, in order.

    Headers are None for a quarantined gap. Positions and lengths count bytes of
    the file. In a compressed archive a record, and a gap within a member, has the
    place and length of its member; the gap's reason names its own place in there.
    """
    if not data.startswith(_MEMBER) and (_VERSION_LINE.search(data) or _MEMBER not in data):
        yield from _salvage_plain(data, 0)
        return
    for start, end, content in _members(data):
        if content is None:
            yield start, end - start, None, b"", "no gzip member"
            continue
        for inner, length, headers, block, reason in _salvage_plain(content, 0):
            if headers is None:
                reason = f"{reason} (member's bytes {inner} to {inner + length})"
            yield start, end - start, headers, block, reason


def _salvage_plain(data: bytes, at: int) -> Iterator[tuple[int, int, dict[str, str] | None, bytes, str]]:
    bad, reason = None, ""
    while at < len(data):
        try:
            end, headers, block = _parse(data, at)
        except ValueError as failed:
            if bad is None:
                bad, reason = at, str(failed)
            # The next version line after the bad place may start a valid record.
            found = _VERSION_LINE.search(data, at + 1)
            at = found.start() if found else len(data)
            continue
        if bad is not None:
            yield bad, at - bad, None, b"", reason
            bad = None
        yield at, end - at, headers, block, ""
        at = end
    if bad is not None:
        yield bad, len(data) - bad, None, b"", reason


def _number(text: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", text or "")
    return int(found[1]) if found else None


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives below `path`, and (with a reason) their gaps: see RECORD and GAP.

    One table: `reason` is null for records, and gaps have only archive,
    position, length and reason, in bytes of the file (see `salvage`). An archive
    is read by one task as a whole, so it should not be larger than some hundred
    MB (Spark refuses files above 2 GB); the writer's archives are not, unless a
    single page is.
    """
    schema = f"{RECORD}, length long, reason string"
    names = [f.split()[0] for f in schema.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    kinds = [types[f.split()[1]] for f in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, data in zip(batch.column("path"), batch.column("content")):
                rows, size = [], 0
                for position, length, headers, block, reason in salvage(data.as_py()):
                    if headers is None:
                        row = (archive.as_py(), position, *[None] * 7, length, reason)
                    else:
                        is_revisit = headers.get("warc-type") == "revisit"
                        told = headers.get("x-payload-length", "")
                        row = (
                            archive.as_py(), position, headers.get("warc-type"), _number(headers.get("warc-record-id")),
                            headers.get("warc-target-uri"),
                            (int(told) if told.isdigit() else None) if is_revisit else len(block),
                            headers.get("warc-payload-digest", "").partition(":")[2] if is_revisit else hashlib.sha1(block).hexdigest(),
                            _number(headers.get("warc-refers-to")), block if payloads else None, length, None,
                        )
                    rows.append(row)
                    size += len(block) if payloads else 0
                    if len(rows) >= 1000 or size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return bounded_batches(files).select("path", "content").mapInArrow(read, schema)


def warc_pages(pages: DataFrame) -> DataFrame:
    """Write an archive record per page to the shared folder and read all of them back."""
    spark = pages.sparkSession
    path = new_folder(spark, "warc")
    write_archives(pages, path)
    records = read_archives(spark, path, payloads=False).filter("reason IS NULL")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
    WITH rows AS (
        SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
    last AS (
        SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last_id FROM rows)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= {LEAST_REVISIT} AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= {LEAST_REVISIT} AND page_id <> last_id THEN last_id END AS refers_to
    FROM last"""
