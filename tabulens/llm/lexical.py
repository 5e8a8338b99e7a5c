"""Ranked lexical search by scanning the documents with an Aho-Corasick automaton.

The distinct terms of all items, each between two separators, make one
automaton, so a match is always a whole term. Documents are never indexed: a
first scan adds up how many documents hold each term and how long documents are,
a second one counts each document's terms, turns the counts into scores of the
items that have them, and keeps the best documents per item in every task. Only
these leave the tasks.

Items go in blocks of a bounded number of terms, one pair of scans per block, so
what is sent to the tasks does not grow with the items.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens.functions.storage import stage
from tabulens.llm.shared import SLICE_BYTES, bounded_batches, give_back, slices, texts_of

TOP = 10
#: Pairs of item and term in a block, unless a single item has more.
BLOCK_TERMS = 200_000
#: Scores (documents times items) that a task computes at a time.
SCORES_AT_ONCE = 2_000_000
SALTS = 64

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BREAK = 0x20
#: Bytes of terms with A-Z lower-cased, a blank for all others; bytes of other signs stay.
_FOLDED = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else _BREAK for b in range(256)
)


@dataclass
class Block:
    """Items and their distinct terms: `holders[t]` are the numbers of the items with term t."""

    items: list = field(default_factory=list)
    terms: dict[str, int] = field(default_factory=dict)
    holders: list[list[int]] = field(default_factory=list)
    pairs: int = 0

    def add(self, new_item: bool, item, term: str) -> None:
        if new_item:
            self.items.append(item)
        number = self.terms.setdefault(term, len(self.terms))
        if number == len(self.holders):
            self.holders.append([])
        self.holders[number].append(len(self.items) - 1)
        self.pairs += 1


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The distinct (item, term); items with the same id are one item."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    terms = F.regexp_extract_all(F.translate(F.col(text), upper, lower), F.lit(TERM), F.lit(0))
    return items.select(F.col(item_id).alias("item"), F.explode(terms).alias("term")).distinct()


def blocks_of(pairs: DataFrame, limit: int) -> Iterator[Block]:
    """Blocks of whole items, read partition by partition; only one block is held at a time."""
    block, last = Block(), None
    for item, term in pairs.orderBy("item", "term").toLocalIterator():
        new = not block.items or item != last
        if new and block.pairs >= limit:
            yield block
            block = Block()
        block.add(new, item, term)
        last = item
    if block.items:
        yield block


_machines: dict[tuple, ahocorasick.Automaton] = {}


def automaton(terms: tuple[str, ...]) -> ahocorasick.Automaton:
    """Every term between two blanks; a Python worker builds it once per block."""
    if terms not in _machines:
        _machines.clear()
        made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for number, term in enumerate(terms):
            made.add_word(f" {term} ", number)
        made.make_automaton()
        _machines[terms] = made
    return _machines[terms]


def term_counts(texts: pa.Array, machine: ahocorasick.Automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms per text, and (text, term, count) of the automaton's terms, ordered by text and term."""
    texts = texts_of(texts)
    data = texts.buffers()[2]
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    folded = bytes(data)[offsets[0] : offsets[-1]].translate(_FOLDED) if data is not None else b""
    offsets = offsets - offsets[0]
    inside = np.frombuffer(folded, np.uint8) != _BREAK
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = offsets[:-1][np.diff(offsets) > 0]
    begins[firsts] = inside[firsts]
    before = np.concatenate(([0], np.cumsum(begins)))
    lengths = before[offsets[1:]] - before[offsets[:-1]]

    # A blank around every text, so that a match lies within one.
    joined = b" ".join([b"", *(folded[s:e] for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())), b""])
    signs = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(signs + 1)
    found = np.fromiter(chain.from_iterable(machine.iter(joined.decode("utf-8", "replace"))), dtype=np.int64)
    found = found.reshape(-1, 2)
    keys = np.searchsorted(ends, found[:, 0]) * len(machine) + found[:, 1]
    keys, counts = np.unique(keys, return_counts=True)
    return lengths, keys // max(1, len(machine)), keys % max(1, len(machine)), counts


def corpus_counts(docs: DataFrame, terms: tuple[str, ...]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and documents per term, over all documents."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(terms)
        held, filled, length = np.zeros(len(terms), dtype=np.int64), 0, 0
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                lengths, _, term, _ = term_counts(part.column("text"), machine)
                held += np.bincount(term, minlength=len(terms))
                filled += int((lengths > 0).sum())
                length += int(lengths.sum())
        some = np.nonzero(held)[0]
        numbers = np.concatenate(([-1, -2], some))
        values = np.concatenate(([filled, length], held[some]))
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(values, pa.int64())], ["term", "value"])
        give_back()

    sums = bounded_batches(docs.select("text")).mapInArrow(local, "term long, value long")
    total = {r["term"]: r["value"] for r in sums.groupBy("term").agg(F.sum("value").alias("value")).collect()}
    held = np.array([total.get(i, 0) for i in range(len(terms))], dtype=np.int64)
    return total.get(-1, 0), total.get(-2, 0), held


def weights_of(documents: int, held: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in held], dtype=np.int64)


def length_measures(lengths: np.ndarray, documents: int, total: int) -> np.ndarray:
    """100 - 90 + (90 * n * N) div L for each length."""
    if 90 * int(lengths.max(initial=0)) * documents < 1 << 62:
        return 10 + 90 * lengths * documents // total
    return np.array([10 + 90 * int(n) * documents // total for n in lengths], dtype=np.int64)


class Best:
    """The best documents per item so far: (item, score, document), null documents last among equals."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.least = np.ones(items, dtype=np.int64)
        self.rows = np.zeros((0, 4), dtype=np.int64)

    def offer(self, scores: np.ndarray, documents: np.ndarray, missing: np.ndarray) -> None:
        """Scores of documents (rows) for items (columns)."""
        at, item = np.nonzero(scores >= self.least)
        new = np.stack([item, -scores[at, item], missing[at], documents[at]], axis=1)
        rows = np.concatenate([self.rows, new])
        rows = rows[np.lexsort(rows.T[::-1])]
        firsts = np.searchsorted(rows[:, 0], rows[:, 0])
        place = np.arange(len(rows)) - firsts
        self.rows = rows[place < self.top]
        full = rows[place == self.top - 1]
        self.least[full[:, 0]] = np.maximum(1, -full[:, 1])


def best_documents(
    docs: DataFrame, block: Block, documents: int, total: int, held: np.ndarray, top: int
) -> DataFrame:
    """(item number, doc_id, score) of the best documents of every task."""
    terms = tuple(block.terms)
    weights, items = weights_of(documents, held), len(block.items)
    sizes = np.array([len(h) for h in block.holders], dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    holders = np.array([i for h in block.holders for i in h], dtype=np.int64)
    at_once = max(1, SCORES_AT_ONCE // items)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, best = automaton(terms), Best(items, top)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                lengths, text, term, count = term_counts(part.column("text"), machine)
                measure = length_measures(lengths, documents, total)
                gained = weights[term] * (10**9 * count // (1000 * count + 8 * measure[text]))
                ids = part.column("doc_id")
                missing = pc.is_null(ids).to_numpy(zero_copy_only=False).astype(np.int64)
                numbers = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
                for low in range(0, part.num_rows, at_once):
                    high = min(low + at_once, part.num_rows)
                    first, last = np.searchsorted(text, [low, high])
                    times = sizes[term[first:last]]
                    ends = np.cumsum(times)
                    places = np.arange(int(ends[-1]) if len(ends) else 0)
                    places += np.repeat(starts[term[first:last]] - (ends - times), times)
                    keys = np.repeat(text[first:last] - low, times) * items + holders[places]
                    scores = np.zeros((high - low) * items, dtype=np.int64)
                    np.add.at(scores, keys, np.repeat(gained[first:last], times))
                    best.offer(scores.reshape(-1, items), numbers[low:high], missing[low:high])
        item, score, empty, doc = best.rows.T
        columns = [pa.array(item), pa.array(doc, mask=empty == 1), pa.array(-score)]
        yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])
        give_back()

    return bounded_batches(docs).mapInArrow(local, "item long, doc_id long, score long")


def ranked(rows: DataFrame, top: int) -> DataFrame:
    """The best of all tasks: first per item and salt, then per item, so that no task gets all tasks' rows of an item."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = rows.withColumn("salt", F.spark_partition_id() % SALTS)
    few = salted.withColumn("rank", F.row_number().over(W.partitionBy("item", "salt").orderBy(*order)))
    few = few.filter(F.col("rank") <= top).drop("rank", "salt")
    return few.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= top)


def search(
    docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS, item_id: str = "item_id"
) -> DataFrame:
    """item_id, rank, doc_id and score of the best documents of every item.

    `docs` has an integer `doc_id` and a `text`, `items` an id and a `text`.
    Null and empty texts have no terms; an item without terms, or whose terms no
    document has, gives no rows, as do empty tables. Items that share an id are
    one item with the terms of all. Repeated documents are ranked one by one;
    null ids come last among equal scores. Texts of any length are scanned whole.
    Other columns do not matter. A single item's terms have to fit the driver.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = items.schema[item_id].dataType
    schema = T.StructType([T.StructField("item_id", kind), *T.StructType.fromDDL("rank int, doc_id long, score long").fields])
    found: list[DataFrame] = []

    def of(block: Block) -> DataFrame | None:
        documents, total, held = corpus_counts(narrow, tuple(block.terms))
        if not total:
            return None
        best = ranked(best_documents(narrow, block, documents, total, held, top), top)
        names = spark.createDataFrame(
            list(enumerate(block.items)), T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", kind)])
        )
        return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")

    for block in blocks_of(item_terms(items, item_id), block_terms):
        if found:  # More than one block: each is written before the next one is held.
            found[-1] = stage(found[-1], "ranked")
        rows = of(block)
        if rows is not None:
            found.append(rows)
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def ranked_documents(spark, folder: str) -> DataFrame:
    from tabulens.llm.shared import table

    return search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


ORACLE = r"""
    WITH terms AS (
        SELECT doc_id, row_number() OVER () AS doc, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term
        FROM documents),
    wanted AS (
        SELECT DISTINCT item_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term
        FROM benchmark),
    lengths AS (SELECT doc, doc_id, count(*) AS n FROM terms GROUP BY ALL),
    corpus AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM lengths),
    counts AS (SELECT doc, term, count(*)::BIGINT AS tf FROM terms WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
    weights AS (
        SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
        FROM counts, corpus GROUP BY term),
    scores AS (
        SELECT item_id, doc_id,
               sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))))::BIGINT AS score
        FROM wanted JOIN counts USING (term) JOIN weights USING (term) JOIN lengths USING (doc), corpus
        GROUP BY item_id, doc, doc_id)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
    WHERE rank <= 10"""
