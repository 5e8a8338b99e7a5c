"""What several of the operators need: words, hashes, slices, names, tables."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulens.functions.storage import new_folder, remove, scope

SPACES = r"[\x20\x09-\x0D]+"
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bounded_batches(df: DataFrame) -> DataFrame:
    """The same table; its session sends Python some MB of text at a time, unless the user set another bound.

    Without a bound a batch is 10,000 rows, which may be gigabytes of long texts.
    """
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(setting, None) is None:
        df.sparkSession.conf.set(setting, str(SLICE_BYTES))
    return df


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive their tasks and wait next to the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def run_stages(spark: SparkSession, docs: DataFrame, folder: str, stages) -> DataFrame:
    """Each stage over what the one before it wrote to the shared folder.

    What a stage stages for itself is removed once its result is written, and a
    result once the next one is: only the last one stays.
    """
    before = None
    for name, function in stages:
        target = new_folder(spark, name)
        with scope(spark):
            function(spark, docs, folder).write.parquet(target)
        docs = spark.read.parquet(target)
        if before:
            remove(spark, before)
        before = target
    return docs


def unused(name: str, columns: list[str]) -> str:
    """A column name that the table does not have, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def one_space(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def texts_of(column: pa.Array | pa.ChunkedArray) -> pa.LargeStringArray:
    """One array without nulls whose offsets cannot overflow."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def slices(batch: pa.RecordBatch | pa.Table, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in order, in pieces of about `limit` bytes of text; a longer text is a piece of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False) if isinstance(sizes, pa.Array) else sizes.to_numpy())
    start = 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def split_words(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, pa.LargeStringArray]:
    """Offsets of the texts' words (one more than texts), and all words in one array.

    Words are what lies between ASCII white space.
    """
    texts = texts_of(texts)
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), out=offsets[1:])
    filled = pc.greater(pc.binary_length(words), 0)
    if not pc.all(filled, min_count=0).as_py():
        words = words.filter(filled)
        kept = np.concatenate(([0], np.cumsum(filled.to_numpy(zero_copy_only=False))))
        offsets = kept[offsets]
    return offsets, words


def word_hashes(words: pa.Array, lower: bool = False) -> np.ndarray:
    """Two 64-bit hashes of each word, as an array with two columns; each different word is hashed once.

    `lower` lower-cases A-Z. It works on the words, which are an array of their
    own: the kernel returns wrong texts for slices of a large string array.
    """
    coded = words.dictionary_encode()
    different = pc.ascii_lower(coded.dictionary) if lower else coded.dictionary
    each = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, different.to_pylist())), dtype=np.uint64)
    return each.reshape(-1, 2)[coded.indices.to_numpy(zero_copy_only=False)]


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values over all positions."""
    values = values ^ (values >> np.uint64(31))
    values *= np.uint64(0x7FB5D329728EA185)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x81DADEF4BC2DD44D)
    values ^= values >> np.uint64(33)
    return values


def rolling(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of every run of `length` neighbours, whatever document they are in."""
    count = len(hashes) - length + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(count, dtype=np.uint64)
    for i in range(length):
        total *= np.uint64(0x9E3779B97F4A7C15)
        total += hashes[i : i + count]
    return mixed(total)


def owners(offsets: np.ndarray) -> np.ndarray:
    """For each word the number of its text."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def inside(offsets: np.ndarray, length: int) -> np.ndarray:
    """Which runs of `length` words, by their start, lie within one text."""
    owner = owners(offsets)
    count = max(0, len(owner) - length + 1)
    return owner[:count] == owner[length - 1 : length - 1 + count]


def power_of_two(least: float, floor: int) -> int:
    """The smallest power of two that is at least both."""
    return 1 << max(int(np.ceil(np.log2(max(least, 1)))), int(np.ceil(np.log2(floor))))
