"""Cutting large text files into records, split by split.

A record may span lines, and a split of a file may start inside one, so no task
can tell on its own where its first record begins. Two passes over the text can:

1. Each split is summed up as what it does to the state of the reader, for every
   state that it may start in. The summaries of a file's splits, one small row
   each, are chained in order: then each split's state at its start is known.
2. Each split is cut with that state. A record that goes on beyond the end of its
   split leaves a piece in each split it touches; only such pieces are grouped.

Splits are Spark's own, so a file of any size is read by as many tasks as it has
splits, and no row holds more than a record.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Key = tuple[str, int]

#: Bytes of text that Python gets at a time, unless the session sets another bound.
_BATCH_BYTES = 4 << 20
_ROWS_AT_ONCE = 1000

#: A whole record, the first piece of one, a later piece of the one that was open at the split's start.
WHOLE, HEAD, REST = "whole", "head", "rest"


def fragments(spark: SparkSession, path: str | list[str], separator: str) -> DataFrame:
    """(value, file, block) of the text between separators, in the order of each split."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(setting, None) is None:
        spark.conf.set(setting, str(_BATCH_BYTES))
    text = spark.read.text(path, lineSep=separator)
    return text.select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )


def by_split(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Key, Iterator[str]]]:
    """The texts of each split; a split's texts must be used up before the next one is asked for."""
    runs = (run for batch in batches for run in _runs(batch))
    waiting = next(runs, None)

    def own(key: Key) -> Iterator[str]:
        nonlocal waiting
        while waiting and waiting[0] == key:
            yield from waiting[1].to_pylist()
            waiting = next(runs, None)

    while waiting:
        key = waiting[0]
        texts = own(key)
        yield key, texts
        for _ in texts:
            pass


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[Key, pa.Array]]:
    """The texts of neighbours that belong to one split."""
    value, file, block = (batch.column(n) for n in ("value", "file", "block"))
    files, blocks = file.dictionary_encode().indices.to_numpy(), block.to_numpy()
    changes = np.nonzero((files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1]))[0] + 1
    bounds = [0, *changes.tolist(), batch.num_rows]
    for start, end in zip(bounds, bounds[1:]):
        if start < end:
            yield (file[start].as_py(), block[start].as_py()), value.slice(start, end - start)


def summed_up(texts: DataFrame, summarise: Callable[[Iterator[str], bool], Any]) -> dict[str, list[tuple[int, Any]]]:
    """Per file the (block, summary) of its splits in order; one row per split comes to the driver.

    ``summarise`` gets the texts of a split and whether it is the first of its
    file, and returns what JSON can hold.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block), own in by_split(batches):
            found = json.dumps(summarise(own, block == 0))
            yield pa.RecordBatch.from_arrays(
                [pa.array([file]), pa.array([block], pa.int64()), pa.array([found])], ["file", "block", "summary"]
            )

    files: dict[str, list[tuple[int, Any]]] = {}
    for row in texts.mapInArrow(local, "file string, block long, summary string").collect():
        files.setdefault(row["file"], []).append((row["block"], json.loads(row["summary"])))
    return {file: sorted(files[file], key=lambda s: s[0]) for file in sorted(files)}


def cut(
    texts: DataFrame,
    states: dict[Key, tuple[Any, int]],
    cutter: Callable[[Any, Iterator[str]], Iterator[tuple[str, str, str]]],
) -> DataFrame:
    """(file, block, row, part, kind, value) of the records, and of pieces of those that span splits.

    ``states`` has each split's state, and the block in which the record that is
    open there began. ``cutter`` yields (kind of record, WHOLE, HEAD or REST,
    text). A piece has the block where its record begins, and its own as ``part``.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def made() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["file", "block", "row", "part", "kind", "value"]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
            rows.clear()
            return batch

        for (file, block), own in by_split(batches):
            state, owner = states[file, block]
            size = 0
            for number, (kind, whole, value) in enumerate(cutter(state, own)):
                part = None if whole == WHOLE else block
                rows.append((file, owner if whole == REST else block, None if whole == REST else number, part, kind, value))
                size += len(value)
                if len(rows) >= _ROWS_AT_ONCE or size > _BATCH_BYTES:
                    yield made()
                    size = 0
        if rows:
            yield made()

    return texts.mapInArrow(local, "file string, block long, row long, part long, kind string, value string")


def joined_pieces(pieces: DataFrame) -> DataFrame:
    """(file, block, row, kind, value) of the records whose pieces lie in several splits; at most two pieces per split."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "value"))), lambda p: p["value"]), "")
    return pieces.groupBy("file", "block", "kind").agg(F.max("row").alias("row"), text.alias("value"))


# Lines of delimited files

_CLOSING = re.compile(r'[^"]*(?:""[^"]*)*"(?!")')


@dataclass(frozen=True)
class Quotes:
    """Tells whether a line ends inside a quoted value, as the CSV reader sees quotes.

    A quote opens a value only where one starts; inside it, two are a quote.
    """

    separator: str

    def ends_inside(self, line: str, inside: bool) -> bool:
        if '"' not in line:
            return inside
        opening = re.compile(rf'(?:^|{re.escape(self.separator)})"')
        at = 0
        while True:
            if not inside:
                found = opening.search(line, at)
                if not found:
                    return False
                at = found.end()
            closed = _CLOSING.match(line, at)
            if not closed:
                return True
            # What follows the closing quote, up to the separator, belongs to the value.
            inside, at = False, closed.end()

    def summarise(self, lines: Iterator[str], first: bool) -> list[bool]:
        """Whether the split ends inside a value if it starts outside, and if it starts inside."""
        outside, inside = False, True
        for line in lines:
            outside, inside = self.ends_inside(line, outside), self.ends_inside(line, inside)
        return [outside, inside]

    def states(self, files: dict[str, list[tuple[int, list[bool]]]]) -> dict[Key, tuple[bool, int]]:
        found: dict[Key, tuple[bool, int]] = {}
        for file, splits in files.items():
            inside, owner = False, 0
            for block, ends in splits:
                found[file, block] = inside, owner
                through = inside and ends[1] and not ends[0]
                inside = ends[inside]
                owner = owner if through else block
        return found

    def cut(self, inside: bool, lines: Iterator[str]) -> Iterator[tuple[str, str, str]]:
        """Records without their line ends; blank lines outside of values are left out."""
        held: list[str] = []
        rest = inside
        for line in lines:
            held.append(line)
            inside = self.ends_inside(line, inside)
            if not inside:
                record = "\n".join(held).removesuffix("\r")
                if rest:
                    # The piece before ended at the end of a line.
                    yield "row", REST, "\n" + record
                elif record.strip():
                    yield "row", WHOLE, record
                held, rest = [], False
        if held:
            yield ("row", REST, "\n" + "\n".join(held)) if rest else ("row", HEAD, "\n".join(held))


# JSON documents

_TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"|["{}\[\]]', re.S)
_STRING_END = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.S)
#: What comes before a bracket, and the bracket, or the quote of a string that does not end.
_NEXT = re.compile(r'[^"{}\[\]]*+(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"[^"{}\[\]]*+)*+(["{}\[\]])', re.S)
_OPENS = re.compile(r"\s*[{\[]")
#: Characters of texts that are searched together.
_CHUNK_CHARS = 1 << 18


@dataclass(frozen=True)
class Place:
    """Where in a JSON document a text starts.

    ``root`` opens the document, ``top`` is the key and opening sign of the
    root's member that the place is in; ``depth`` counts what is open.
    """

    inside: bool = False
    depth: int = 0
    root: str = ""
    top: tuple[str, str] | None = None

    @property
    def target(self) -> tuple[str, int] | None:
        """What is wanted here, and the depth around it: records, or the metadata."""
        if self.root == "[":
            return "row", 1
        if self.top == ("data", "["):
            return "row", 2
        if self.top == ("_meta", "{"):
            return "meta", 1
        return None


def _signs(text: str, inside: bool) -> tuple[list[tuple[str, int, str]], bool]:
    """(bracket, place, key before it) of the brackets outside of strings, and whether the text ends inside a string."""
    at = 0
    if inside:
        end = _STRING_END.match(text)
        if not end:
            return [], True
        at = end.end()
    found: list[tuple[str, int, str]] = []
    for token in _NEXT.finditer(text, at):
        sign, place = token[1], token.start(1)
        if sign == '"':
            return found, True
        found.append((sign, place, _key(text, token.start(), place) if sign in "{[" else ""))
    return found, False


def _key(text: str, start: int, end: int) -> str:
    """The last string of a stretch between two brackets, if only a colon follows it."""
    while end > start and text[end - 1].isspace():
        end -= 1
    if end == start or text[end - 1] != ":":
        return ""
    key, key_end = "", -1
    for token in _TOKEN.finditer(text, start, end):
        key, key_end = token[0][1:-1], token.end()
    return key if key_end >= 0 and text[key_end:end].strip() == ":" else ""


def _chunks(texts: Iterator[str], place: Place) -> Iterator[str]:
    """Texts with the braces that ended them, many at a time.

    Where no document is open and none opens, each text comes alone: what
    follows a bracket that closes nothing is ignored up to the next brace.
    """
    held: list[str] = []
    size, most = 0, _CHUNK_CHARS
    for number, text in enumerate(texts):
        if not number and not place.root and (place.inside or place.depth or not _OPENS.match(text)):
            most = 0
        held.append(text)
        size += len(text) + 1
        if size >= most:
            yield "}".join(held) + "}"
            held, size = [], 0
    if held:
        yield "}".join(held) + "}"


class Documents:
    """Documents ``{_meta, data[]}`` and ``[...]``, in texts between closing braces.

    Every text is followed by the brace that ended it. The last one of a file may
    not be, but by then the document is closed, and what follows is ignored.
    """

    separator = "}"

    @staticmethod
    def summarise(texts: Iterator[str], first: bool) -> list[dict]:
        """For a start outside and inside of a string: where the split ends, relative to its start.

        ``low`` is the least depth, and ``last`` the member that was opened there
        and is still open (in a file's first split, that of the root).
        """
        starts = (False,) if first else (False, True)
        runs = [{"inside": i, "delta": 0, "low": 0, "last": None, "root": "", "known": False} for i in starts]
        for text in _chunks(texts, Place() if first else Place(root="[")):
            for run in runs:
                if first and run["root"] and not run["delta"]:
                    continue  # the document is closed
                signs, run["inside"] = _signs(text, run["inside"])
                for sign, at, key in signs:
                    members = 1 if first else run["low"]
                    if sign in "{[":
                        run["root"] = run["root"] or sign if first else ""
                        if key and run["delta"] == members:
                            run["last"] = [key, sign]
                            run["known"] = run["known"] or key in ("_meta", "data")
                        run["delta"] += 1
                        continue
                    run["delta"] -= 1
                    if run["delta"] <= members:
                        run["last"] = None
                    run["low"] = min(run["low"], run["delta"])
                    if first and not run["delta"]:
                        # What follows is ignored, from the next brace on.
                        run["inside"] = _signs(text[at + 1 : text.index("}", at) + 1], False)[1]
                        break
        return runs

    @staticmethod
    def hold_records(files: dict[str, list[tuple[int, list[dict]]]]) -> bool:
        """Whether any file is a list, or has metadata or data."""
        return any(run["known"] or run["root"] == "[" for splits in files.values() for _, runs in splits for run in runs)

    @staticmethod
    def states(files: dict[str, list[tuple[int, list[dict]]]]) -> dict[Key, tuple[Place, int]]:
        found: dict[Key, tuple[Place, int]] = {}
        for file, splits in files.items():
            place, owner = Place(), 0
            for block, runs in splits:
                found[file, block] = place, owner
                run = runs[place.inside if len(runs) > 1 else 0]
                low, target = place.depth + run["low"], place.target
                through = target is not None and place.depth > target[1] and low > target[1]
                top = place.top
                if not place.root or low == 1:
                    top = tuple(run["last"]) if run["last"] else None
                elif low < 1:
                    top = None
                depth = place.depth + run["delta"]
                place = Place(run["inside"], depth, place.root or run["root"], top)
                owner = owner if through else block
        return found

    @staticmethod
    def cut(place: Place, texts: Iterator[str]) -> Iterator[tuple[str, str, str]]:
        """Records of ``data`` or of the list, and the metadata, as JSON text."""
        inside, depth = place.inside, place.depth
        target = place.target
        taking = target is not None and depth > target[1]
        rest, held = taking, []
        for text in _chunks(texts, place):
            if depth <= 0 and place.root:
                break
            begin = 0
            signs, inside = _signs(text, inside)
            for sign, at, key in signs:
                if sign in "{[":
                    if depth == 0:
                        place = replace(place, root=sign)
                    elif depth == 1 and place.root == "{":
                        place = replace(place, top=(key, sign))
                    depth += 1
                    target = place.target
                    if not taking and target is not None and depth == target[1] + 1 and sign == "{":
                        taking, rest, begin, held = True, False, at, []
                    continue
                depth -= 1
                if taking and depth == target[1]:
                    held.append(text[begin : at + 1])
                    yield target[0], REST if rest else WHOLE, "".join(held)
                    taking, rest, held = False, False, []
                if depth <= 1 and place.root == "{":
                    place = replace(place, top=None)
                if depth <= 0:
                    break
            if taking:
                held.append(text[begin:])
        if taking and held:
            yield target[0], REST if rest else HEAD, "".join(held)
