"""Hierarchical residual packing: tasks pack best-fit, underfull bins go up a tree as items.

Every task tokenizes its documents, cuts only those longer than a sequence, and
packs its pieces best-fit, longest first, in runs of a bounded number. Nearly
full bins are done and leave. Every other bin is an item of the next level, where
a task gets the bins of sixteen tasks and packs them best-fit again, and so on up
to the root, whose bins are all done. Only (bin, fill) goes up; a bin that is put
into another one is noted as a move, and pieces follow the moves of their bin in
the end by joins.

Two large bins that leave much room should not be married for good: below the
root, a bin that is over half full but not nearly full goes up as parts, none of
which is over half full unless it is a single item.

A group of more bins than a task should hold is split by hash, and every level is
written to the shared folder, so neither size nor a lost executor matters.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulens.functions.storage import stage
from tabulens.llm.shared import bounded_batches, give_back, slices
from tabulens.llm.tokenizing import SLICE_BYTES, default_vocabulary, encode_texts

CAPACITY = 2048
END = 0
#: A bin with no more free places than this is done.
NEARLY = 4
#: Bins are numbered by task and, in so many bits, within it.
TASK_BITS = 40
#: Tasks whose bins one task of the next level gets.
FAN = 16
#: Pieces that a task packs, and writes, together.
RUN_PIECES = 100_000
#: Bins that a task of the tree packs together.
RUN_BINS = 200_000

FIELDS = ["doc_id", "piece", "start", "length", "ids_crc32"]
#: A piece with its bin, the offset in it, and the fill of the bin.
LEVEL = "bin long, at long, fill long, doc_id long, piece int, start long, length long, ids_crc32 long"
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
#: A bin in the tree: the bin that holds it now, its offset there, and the fill of that bin.
MERGED = "bin long, holder long, at long, fill long, node long, done boolean"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest items first, each into the fullest bin that it fits.

    Bins wait by their free places; the places in use are a sorted list of at
    most `capacity` values, so an item costs a binary search.
    """
    bins: list[list[int]] = []
    waiting: dict[int, list[int]] = {}
    free: list[int] = []
    for item in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        size = sizes[item]
        at = bisect_left(free, size)
        if at < len(free):
            room = free[at]
            number = waiting[room].pop()
            if not waiting[room]:
                del waiting[room]
                free.pop(at)
            bins[number].append(item)
        else:
            room, number = capacity, len(bins)
            bins.append([item])
        left = room - size
        if left > 0:
            if left not in waiting:
                waiting[left] = []
                insort(free, left)
            waiting[left].append(number)
    return bins


def bins_of(sizes: list[int], capacity: int, last: bool) -> Iterator[tuple[list[int], int, bool]]:
    """(items, fill, done) of the best-fit bins; those that are not done go up.

    `last` makes all bins done. Otherwise one that is neither nearly full nor at
    most half full is taken apart, into items over half of the capacity and
    best-fit bins of up to half.
    """
    for members in best_fit(sizes, capacity):
        fill = sum(sizes[i] for i in members)
        if last or fill >= capacity - NEARLY:
            yield members, fill, True
        elif 2 * fill <= capacity:
            yield members, fill, False
        else:
            for part in best_fit([sizes[i] for i in members], capacity // 2):
                chosen = [members[i] for i in part]
                yield chosen, sum(sizes[i] for i in chosen), False


def pieces_of(docs: Iterator[pa.RecordBatch], vocabulary: str, capacity: int) -> Iterator[tuple]:
    """The `FIELDS` of the pieces of all documents in order, each document with its end id."""
    for batch in docs:
        for part in slices(batch, "text", SLICE_BYTES):
            ids, offsets = encode_texts(part.column("text"), vocabulary)
            for doc, s, e in zip(part.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                own = np.append(ids[s:e], END).astype("<u4")
                for number, start in enumerate(range(0, len(own), capacity)):
                    cut = own[start : start + capacity]
                    yield doc, number, start, len(cut), zlib.crc32(cut.tobytes())


def _local(items: list[tuple], capacity: int, first: int) -> Iterator[tuple]:
    """The items as rows of `LEVEL`, with bins numbered from `first`."""
    for number, (members, fill, done) in enumerate(bins_of([item[3] for item in items], capacity, False), first):
        at = 0
        for i in members:
            yield number, at, fill, *items[i]
            at += items[i][3]


def merged_level(bins: DataFrame, nodes: int, count: int, capacity: int) -> DataFrame:
    """The bins (bin, fill, node) packed per `FAN` nodes into rows of `MERGED`; the first of a holder's bins names it."""
    parents = -(-nodes // FAN)
    parts = max(1, -(-count // (parents * RUN_BINS)))
    last, at_once = parents == 1, RUN_BINS

    def packed(group: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
        rows = []
        for members, fill, done in bins_of([g[1] for g in group], capacity, last):
            at = 0
            for i in members:
                rows.append((group[i][0], group[members[0]][0], at, fill, group[i][2], done))
                at += group[i][1]
        kinds = [*[pa.int64()] * 5, pa.bool_()]
        names = [part.split()[0] for part in MERGED.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple[int, int, int]] = []
        key = None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("bin", "fill", "parent", "part")]
            for number, fill, parent, part in zip(*columns):
                if group and (key != (parent, part) or len(group) >= at_once):
                    yield from packed(group)
                    group = []
                key = parent, part
                group.append((number, fill, parent))
        if group:
            yield from packed(group)
        give_back()

    spread = F.xxhash64("bin", F.lit(nodes))
    keyed = bins.select("bin", "fill", F.expr(f"node div {FAN}").alias("parent"), F.pmod(spread, F.lit(parts)).alias("part"))
    dealt = keyed.repartition("parent", "part").sortWithinPartitions("parent", "part", spread, "bin")
    return dealt.mapInArrow(merge, MERGED)


def merge_bins(bins: DataFrame, capacity: int = CAPACITY) -> DataFrame | None:
    """(bin, holder, shift) of every bin (bin, fill, node) that ends in another one; None where there are no bins.

    `node` numbers the tasks that the bins come from.
    """
    moves: DataFrame | None = None
    while True:
        count, top = bins.agg(F.count(F.lit(1)), F.max("node")).first()
        if not count:
            return moves
        level = stage(merged_level(bins, top + 1, count, capacity), "bins")
        new = level.filter("bin <> holder").select("bin", "holder", F.col("at").alias("shift"))
        if moves is not None:
            later = new.select(F.col("bin").alias("moved"), F.col("holder").alias("into"), F.col("shift").alias("more"))
            followed = moves.join(later, F.col("holder") == F.col("moved"), "left").select(
                "bin", F.coalesce("into", "holder").alias("holder"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")
            )
            new = followed.unionByName(new)
        moves = new
        if top < FAN:
            return moves
        bins = level.filter("bin = holder AND NOT done").select("bin", "fill", "node")


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece.

    Null and empty texts are a single end id, very long ones are cut into many
    pieces. Null ids and repeated rows are packed like others. An empty table
    gives no rows. `docs` has an integer `doc_id` and a `text`; other columns do
    not matter.
    """
    vocabulary = vocabulary or default_vocabulary()
    at_once = RUN_PIECES

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in LEVEL.split(", ")]
        found, first = pieces_of(batches, vocabulary, capacity), TaskContext.get().partitionId() << TASK_BITS
        while run := list(islice(found, at_once)):
            rows = list(_local(run, capacity, first))
            first = rows[-1][0] + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), KINDS)], names)
        give_back()

    dealt = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    level = stage(dealt.mapInArrow(local, LEVEL), "pieces")
    full = F.col("fill") >= capacity - NEARLY
    placed = level.filter(full).select(*FIELDS, F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    left = level.filter(~full)
    moves = merge_bins(left.filter("at = 0").select("bin", "fill", F.shiftright("bin", TASK_BITS).alias("node")), capacity)
    if moves is None:
        return placed
    followed = left.join(moves.withColumnRenamed("bin", "moved"), F.col("bin") == F.col("moved"), "left")
    return placed.unionByName(
        followed.select(
            *FIELDS,
            F.coalesce("holder", "bin").alias("sequence_id"),
            (F.col("at") + F.coalesce("shift", F.lit(0))).alias("offset"),
        )
    )


def packed_documents(docs: DataFrame) -> DataFrame:
    return pack(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return pack(docs)
