"""Token ids in ORC: run-length encoded integers, row indexes, Bloom filters on ids.

Documents are range-partitioned by id and written in ascending order, one row
per document. Stripes are read in parallel; a search for ids skips files and
stripes by their statistics and row groups by the Bloom filter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulens.functions.storage import new_folder
from tabulens.llm.shared import bounded_batches, give_back, slices
from tabulens.llm.tokenizing import SLICE_BYTES, default_vocabulary, encode_texts

END = 2
STRIPE_BYTES = 16 << 20
#: Rows per index entry; documents have some hundred ids each.
STRIDE = 1000


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end: int = END) -> None:
    """Write (doc_id, part, before, n, ids): `before` counts the ids that precede in the same part.

    Null texts are empty and have the end id only. Rows without an id come
    first. Repeated rows are all written. An empty table makes an empty folder
    with a schema.
    """
    vocabulary = vocabulary or default_vocabulary()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                ids, offsets = encode_texts(part.column("text"), vocabulary)
                ids = np.insert(ids, offsets[1:], end)
                offsets = offsets + np.arange(len(offsets))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                starts, sizes = pa.array(before + offsets[:-1], pa.int64()), pa.array(np.diff(offsets), pa.int64())
                before += len(ids)
                columns = [part.column("doc_id"), starts, sizes, lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "before", "n", "ids"])
        give_back()

    ordered = bounded_batches(docs).select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first())
    encoded = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first()).mapInArrow(
        encode, f"doc_id {kind}, before long, n long, ids array<int>"
    )
    numbered = encoded.select("doc_id", F.spark_partition_id().alias("part"), "before", "n", "ids")
    options = {
        "compression": "zstd",
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": "0.01",
        "orc.create.index": "true",
        "orc.row.index.stride": str(STRIDE),
        "orc.stripe.size": str(STRIPE_BYTES),
    }
    numbered.write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: Sequence[int] | None = None) -> DataFrame:
    """All documents of the files, or those with the given ids; the ids reach the ORC reader."""
    rows = spark.read.schema("doc_id long, part int, before long, n long, ids array<int>").orc(path)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(list(doc_ids)))


def positions(rows: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of rows read."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            offsets = lists.offsets.to_numpy()
            data, bounds = memoryview(ids).cast("B"), (offsets * 4).tolist()
            crcs = [zlib.crc32(data[s:e]) for s, e in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [*batch.select(["doc_id", "part", "before"]).columns, pa.array(np.diff(offsets), pa.int64()), pa.array(crcs, pa.int64())],
                ["doc_id", "part", "before", "n_tokens", "ids_crc32"],
            )

    counted = bounded_batches(rows).select("doc_id", "part", "before", "ids").mapInArrow(count, "doc_id long, part int, before long, n_tokens long, ids_crc32 long")
    # One row per written part, whatever the number of documents.
    totals = rows.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("n"))
    upto = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).cast("long").alias("base"))
    return counted.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_file_documents(docs: DataFrame) -> DataFrame:
    """Write the files to the shared folder and read every document back."""
    spark = docs.sparkSession
    path = new_folder(spark, "tokens")
    write_tokens(docs, path)
    return positions(read_tokens(spark, path))
