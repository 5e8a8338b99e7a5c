"""Repeated passages: fixed-block anchors, rolling probes, maximal repeats.

Every run of `window` words that occurs twice contains, in each of its places,
a block of half that length that starts at a multiple of the block length.

1. Index and probe. Each batch of documents sends the hashes of all rolling
   blocks, marked where the block is one of the non-overlapping reference
   blocks. Hashes meet by their leading bits. Those that occur twice and once
   as a reference block are hits; they go back to the batches that sent them.
2. Extend. Whole windows around hits are candidates. Each batch sends the hash
   and first place of its different candidates; the first place overall wins,
   the other batches learn that theirs comes later.
3. Remove. Words under any window that started earlier go. Neighbouring windows
   merge into maximal repeats by covering.

No pairs of documents are listed: a passage in a third of all documents is one
entry per batch. What is sent are sorted hash arrays by byte planes, which the
shuffle compresses to 4 to 5 bytes per word; texts are shuffled once, as Spark
reuses that exchange in all three steps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.llm.shared import bounded_batches, give_back, inside, power_of_two, rolling, split_words, unused, word_hashes

#: Characters of text in a batch, and block hashes that one task of the index compares. A batch takes some 30 times
#: its characters of memory for a moment; with more memory, larger batches send fewer and longer rows.
BATCH_CHARS = 4 << 20
INDEX_ENTRIES = 1 << 20
#: Bits of a block hash. False hits only add candidates.
HASH_BITS = 48
_LAST = np.iinfo(np.int64).max


def planes(values: np.ndarray) -> bytes:
    """Byte planes of sorted values: leading planes hardly change and compress away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def unplanes(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


class Words:
    """The words of a batch in the order (id, text), with hashes and places."""

    def __init__(self, batch: pa.Table, id_column: str, text: str):
        ids = batch.column(id_column).cast(pa.int64()).combine_chunks()
        self.ids = ids.fill_null(_LAST).to_numpy(zero_copy_only=False)
        self.order = np.argsort(self.ids, kind="stable")
        texts = batch.column(text).combine_chunks().cast(pa.large_string()).take(pa.array(self.order))
        self.ids = self.ids[self.order]
        self.offsets, self.words = split_words(texts)
        self.hashes = word_hashes(self.words)
        self.owner = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.offsets))
        self.place = np.arange(len(self.owner)) - self.offsets[self.owner]

    def blocks(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all rolling blocks and their hashes, two low bits left free."""
        starts = np.nonzero(inside(self.offsets, length))[0]
        keys = rolling(self.hashes[:, 0], length)[starts] >> np.uint64(64 - HASH_BITS)
        return starts, keys & ~np.uint64(3)

    def windows(self, starts: np.ndarray, length: int) -> np.ndarray:
        """A 96-bit hash of the windows at these places: columns of 64 and 32 bits."""
        both = [rolling(self.hashes[:, i], length)[starts] for i in range(2)]
        return np.stack([both[0], both[1] >> np.uint64(32)], axis=1)


def _pieces(keys: np.ndarray, bits: int, width: int) -> list[tuple[int, int, int]]:
    """(part, start, end) of the runs of sorted keys with the same leading bits."""
    parts = (keys >> np.uint64(width - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    ends = np.append(np.nonzero(np.diff(parts))[0] + 1, len(parts))
    starts = np.concatenate(([0], ends[:-1]))
    return [(int(parts[s]), int(s), int(e)) for s, e in zip(starts, ends) if e > s]


def _by_hash(found: np.ndarray) -> np.ndarray:
    """A stable order in which equal window hashes are neighbours."""
    order = np.argsort(found[:, 0], kind="stable")
    high, low = found[order, 0], found[order, 1]
    if ((high[1:] == high[:-1]) & (low[1:] != low[:-1])).any():
        return np.lexsort((found[:, 1], found[:, 0]))
    return order


def _rows(columns: dict[str, list], types: dict[str, pa.DataType]) -> pa.Table:
    return pa.table({n: pa.array(v, types[n]) for n, v in columns.items()})


def remove_repeats(
    docs: DataFrame, text: str = "text", id_column: str = "doc_id", window: int = 20, removed: str = "n_removed",
    words: str = "n_words",
) -> DataFrame:
    """The table without words that a window covers which also starts earlier.

    Earlier is a smaller id, or an earlier place in the same document. Windows
    are judged on the input. A text from which words go becomes the other words
    joined by one space; other texts stay as they are. Two columns are added
    (`words`, `removed`; a column of that name is replaced).

    Null texts have no words and stay null; rows without an id come last, in a
    fixed order; of repeated rows the first keeps its words. An empty table
    stays empty. Ids are integers.
    """
    docs = bounded_batches(docs).drop(words, removed)
    block = window // 2
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    batches = max(1, -(-chars // BATCH_CHARS))
    bits = power_of_two(chars / 6 / INDEX_ENTRIES, 4).bit_length() - 1
    batch = unused("batch", docs.columns)
    dealt = docs.withColumn(batch, F.pmod(F.xxhash64(id_column, text), F.lit(batches)))

    def send_blocks(rows: pa.Table) -> pa.Table:
        here = Words(rows, id_column, text)
        starts, keys = here.blocks(block)
        order = np.argsort(keys, kind="stable")
        keys, reference = keys[order], here.place[starts[order]] % block == 0
        first = np.nonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])[0]
        counts = np.diff(np.append(first, len(keys)))
        marks = np.maximum.reduceat(reference.astype(np.uint64), first) if len(first) else reference[:0].astype(np.uint64)
        sent = keys[first] | marks | (np.uint64(2) * (counts > 1).astype(np.uint64))
        give_back()
        runs = _pieces(sent, bits, HASH_BITS)
        number = rows.column(batch)[0].as_py()
        columns = {
            "part": [p for p, _, _ in runs],
            "batch": [number] * len(runs),
            "entries": [planes(sent[s:e]) for _, s, e in runs],
        }
        return _rows(columns, {"part": pa.int32(), "batch": pa.int64(), "entries": pa.binary()})

    def find_hits(rows: pa.Table) -> pa.Table:
        each = [unplanes(x, "<u8") for x in rows.column("entries").to_pylist()]
        sent = np.concatenate(each)
        source = np.repeat(np.arange(len(each)), [len(x) for x in each])
        order = np.argsort(sent >> np.uint64(2), kind="stable")
        sent, source = sent[order], source[order]
        keys = sent & ~np.uint64(3)
        first = np.nonzero(np.append(True, keys[1:] != keys[:-1]))[0]
        counts = np.diff(np.append(first, len(keys)))
        marks = np.bitwise_or.reduceat(sent, first)
        hit = ((marks & np.uint64(1)) > 0) & ((counts > 1) | ((marks & np.uint64(2)) > 0))
        again = np.repeat(hit, counts)
        return _answers(rows, source[again], [keys[again]])

    def send_windows(rows: pa.Table, hits: pa.Table) -> pa.Table:
        types = {"part": pa.int32(), "batch": pa.int64()} | dict.fromkeys(("high", "low", "ids", "places"), pa.binary())
        if not rows.num_rows or not hits.num_rows:
            return _rows({n: [] for n in types}, types)
        here = Words(rows, id_column, text)
        known = np.sort(np.concatenate([unplanes(x, "<u8") for x in hits.column("high").to_pylist()]))
        starts, keys = here.blocks(block)
        at = np.searchsorted(known, keys)
        is_hit = np.zeros(len(here.owner) + 1, dtype=np.int64)
        is_hit[starts] = known[np.minimum(at, len(known) - 1)] == keys
        upto = np.concatenate(([0], np.cumsum(is_hit)))
        full = np.nonzero(inside(here.offsets, window))[0]
        full = full[upto[full + window - block + 1] > upto[full]]
        found = here.windows(full, window)
        order = _by_hash(found)
        found, full = found[order], full[order]
        new = np.append(True, (found[1:] != found[:-1]).any(axis=1))[: len(found)]
        found, full = found[new], full[new]
        give_back()
        runs = _pieces(found[:, 0], bits, 64)
        number = rows.column(batch)[0].as_py()
        owner = here.owner[full]
        cut = lambda values, kind: [planes(values[s:e].astype(kind)) for _, s, e in runs]
        columns = {
            "part": [p for p, _, _ in runs],
            "batch": [number] * len(runs),
            "high": cut(found[:, 0], "<u8"),
            "low": cut(found[:, 1], "<u4"),
            "ids": cut(here.ids[owner], "<i8"),
            "places": cut(here.place[full], "<i4"),
        }
        return _rows(columns, types)

    def find_later(rows: pa.Table) -> pa.Table:
        numbers = np.array(rows.column("batch").to_pylist())
        read = lambda name, kind: [unplanes(x, kind) for x in rows.column(name).to_pylist()]
        high = read("high", "<u8")
        source = np.repeat(np.arange(len(high)), [len(x) for x in high])
        high, low, ids, places = map(
            np.concatenate, (high, read("low", "<u4"), read("ids", "<i8"), read("places", "<i4"))
        )
        order = np.lexsort((numbers[source], places, ids, low, high))
        high, low, source = high[order], low[order], source[order]
        later = np.append(False, (high[1:] == high[:-1]) & (low[1:] == low[:-1]))
        return _answers(rows, source[later], [high[later], low[later].astype(np.uint64)])

    def _answers(rows: pa.Table, source: np.ndarray, values: list[np.ndarray]) -> pa.Table:
        """For each sent row the values that concern it; one binary column per array of values."""
        give_back()
        numbers = rows.column("batch").to_pylist()
        order = np.argsort(source, kind="stable")
        source = source[order]
        ends = np.append(np.nonzero(np.diff(source))[0] + 1, len(source)) if len(source) else source
        begins = np.concatenate(([0], ends[:-1])) if len(source) else source
        columns = {"batch": [numbers[source[s]] for s in begins]}
        for name, array in zip(("high", "low"), values):
            columns[name] = [planes(array[order][s:e]) for s, e in zip(begins, ends)]
        return _rows(columns, {"batch": pa.int64(), "high": pa.binary(), "low": pa.binary()})

    def cut_words(rows: pa.Table, later: pa.Table) -> pa.Table:
        here = Words(rows, id_column, text)
        full = np.nonzero(inside(here.offsets, window))[0]
        found = here.windows(full, window)
        if later.num_rows:
            high = np.concatenate([unplanes(x, "<u8") for x in later.column("high").to_pylist()])
            low = np.concatenate([unplanes(x, "<u8") for x in later.column("low").to_pylist()])
            # What starts earlier elsewhere stands before all windows of this batch.
            found = np.concatenate([np.stack([high, low], axis=1), found])
            full = np.concatenate([np.full(len(high), -1), full])
        order = _by_hash(found)
        found, full = found[order], full[order]
        later_here = np.append(False, (found[1:] == found[:-1]).all(axis=1))[: len(found)]
        gone = full[later_here & (full >= 0)]
        cover = np.zeros(len(here.owner) + window + 1, dtype=np.int64)
        np.add.at(cover, gone, 1)
        np.add.at(cover, gone + window, -1)
        kept = np.cumsum(cover)[: len(here.owner)] == 0
        total = np.concatenate(([0], np.cumsum(~kept)))
        n_removed = total[here.offsets[1:]] - total[here.offsets[:-1]]
        rows = rows.take(pa.array(here.order))
        texts = rows.column(text).to_pylist()
        for i in np.nonzero(n_removed)[0]:
            s, e = here.offsets[i], here.offsets[i + 1]
            texts[i] = " ".join(here.words.slice(s, e - s).filter(pa.array(kept[s:e])).to_pylist())
        give_back()
        out = rows.set_column(rows.schema.get_field_index(text), text, pa.array(texts, pa.string()))
        out = out.drop_columns([batch]).append_column(words, pa.array(np.diff(here.offsets), pa.int64()))
        return out.append_column(removed, pa.array(n_removed, pa.int64()))

    sent = dealt.groupBy(batch).applyInArrow(send_blocks, "part int, batch long, entries binary")
    hits = sent.groupBy("part").applyInArrow(find_hits, "batch long, high binary")
    candidates = (
        dealt.groupBy(batch)
        .cogroup(hits.groupBy("batch"))
        .applyInArrow(send_windows, "part int, batch long, high binary, low binary, ids binary, places binary")
    )
    later = candidates.groupBy("part").applyInArrow(find_later, "batch long, high binary, low binary")
    schema = docs.withColumns({words: F.lit(0).cast("long"), removed: F.lit(0).cast("long")}).schema
    return dealt.groupBy(batch).cogroup(later.groupBy("batch")).applyInArrow(cut_words, schema)


def substring_documents(docs: DataFrame) -> DataFrame:
    """The contract's columns: the kept words of every document joined by one space."""
    left = remove_repeats(docs.select("doc_id", "text"))
    spaced = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "), "^ | $", "")
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.encode(spaced, "utf-8"), 256).alias("kept_sha256"))


def substring_stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, without their repeated passages; `n_chars` follows the text."""
    added = [unused("words_before", docs.columns), unused("words_removed", docs.columns)]
    left = remove_repeats(docs, words=added[0], removed=added[1])
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col(added[1]) > 0, F.length("text")).otherwise(F.col("n_chars")))
    return left.select(*[F.col(f.name).cast(f.dataType) for f in docs.schema])


ORACLE = r"""
    WITH words AS (
        SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
        FROM documents),
    starts AS (
        SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS nth
        FROM (SELECT doc_id, i, array_to_string(ws[i : i + 19], ' ') AS win
              FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM words))),
    gone AS (
        SELECT doc_id, list(DISTINCT i + j) AS places FROM starts, range(0, 20) t(j) WHERE nth > 1 GROUP BY doc_id)
    SELECT doc_id, len(ws) AS n_words, coalesce(len(places), 0) AS n_removed,
           sha256(array_to_string(CASE WHEN places IS NULL THEN ws ELSE
               list_filter(ws, lambda w, i: NOT list_contains(places, i)) END, ' ')) AS kept_sha256
    FROM words LEFT JOIN gone USING (doc_id)"""
