"""Byte-pair encoding with a contiguous array of ranks, and decoding.

A short word is held as part boundaries and the ranks of adjacent parts, both
in plain arrays. The smallest rank is searched by a scan, its boundary deleted,
and the two neighbouring ranks are looked up anew. For words of some ten bytes
that is faster than any queue. Longer words, where the scans would cost the
square of the length, use a heap over linked parts with the same order of
merges: smallest rank first, leftmost among equals.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabulens.llm.shared import bounded_batches, give_back, slices, split_words
from tabulens.llm.tokenizing import KEPT_WORDS, byte_signs, default_vocabulary, encode_words

#: Bytes up to which a word counts as short.
SHORT = 128
_NONE = 1 << 30

_loaded: dict[str, Vocabulary] = {}


class Vocabulary:
    """What a tokenizer file says: tokens, ranks of merges, patterns, special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: Rank of a pair of neighbouring parts, and the part that each rank makes.
        self.ranks = {(self.ids[a], self.ids[b]): r for r, (a, b) in enumerate(pairs)}
        self.made = [self.ids[a + b] for a, b in pairs]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"])
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.signs = byte_signs()
        #: Splits text with signs that Python's Unicode tables do not have yet.
        self.newer = Tokenizer.from_file(path)
        self.piece_ids: dict[str, list[int]] = {}
        self.word_ids: dict[str, bytes] = {}

    def parts(self, piece: str) -> list[int]:
        """Ids of the single bytes; the last one ends the word."""
        signs = [self.signs[b] for b in piece.encode("utf-8")]
        signs[-1] += self.suffix
        return [self.ids[s] for s in signs]

    def merge_short(self, parts: list[int]) -> list[int]:
        rank = self.ranks.get
        bounds = list(range(len(parts) + 1))
        ranks = [rank(pair, _NONE) for pair in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            parts[bounds[i]] = self.made[least]
            del bounds[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank((parts[bounds[i]], parts[bounds[i + 1]]), _NONE)
            if i:
                ranks[i - 1] = rank((parts[bounds[i - 1]], parts[bounds[i]]), _NONE)
        return [parts[b] for b in bounds[:-1]]

    def merge_long(self, parts: list[int]) -> list[int]:
        rank = self.ranks.get
        count = len(parts)
        after, before = list(range(1, count + 1)), list(range(-1, count - 1))
        heap = [(r, i) for i, pair in enumerate(zip(parts, parts[1:])) if (r := rank(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            least, i = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else count
            # An entry is out of date if either part has been merged meanwhile.
            if j >= count or rank((parts[i], parts[j])) != least:
                continue
            parts[i], parts[j] = self.made[least], None
            after[i] = after[j]
            if after[j] < count:
                before[after[j]] = i
                if (r := rank((parts[i], parts[after[i]]))) is not None:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := rank((parts[before[i]], parts[i]))) is not None:
                heapq.heappush(heap, (r, before[i]))
        return [p for p in parts if p is not None]

    def merge(self, parts: list[int]) -> list[int]:
        return self.merge_short(parts) if len(parts) <= SHORT else self.merge_long(parts)

    def encode_piece(self, piece: str) -> list[int]:
        found = self.piece_ids.get(piece)
        if found is None:
            found = self.merge(self.parts(piece))
            if len(self.piece_ids) >= KEPT_WORDS:
                self.piece_ids.clear()
            if len(piece) <= SHORT:
                self.piece_ids[piece] = found
        return found

    def encode(self, text: str) -> list[int]:
        """Ids of any text."""
        ids: list[int] = []
        for part in self.specials.split(text) if self.specials and "<" in text else (text,):
            if part in self.special:
                ids.append(self.special[part])
                continue
            if not part.isascii():
                if any(unicodedata.category(c) == "Cn" for c in part):
                    part = self.newer.normalizer.normalize_str(part)
                    for signs, _ in self.newer.pre_tokenizer.pre_tokenize_str(part):
                        ids += self.merge([self.ids[s] for s in (*signs[:-1], signs[-1] + self.suffix)])
                    continue
                part = "".join(map(str.lower, unicodedata.normalize("NFC", part)))
            else:
                part = part.lower()
            for piece in self.pieces.findall(part):
                ids += self.encode_piece(piece)
        return ids

    def encode_list(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit bytes."""
        known = self.word_ids
        if len(known) > KEPT_WORDS:
            known.clear()
        found = []
        for word in words:
            data = known.get(word)
            if data is None:
                data = np.asarray(self.encode(word), dtype="<u4").tobytes()
                if len(known) <= KEPT_WORDS and len(word) <= SHORT:
                    known[word] = data
            found.append(data)
        return found

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space, special tokens included; ids without a token are left out."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids if i in tokens])


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def encode_decode(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """The table without its text, with `ids` (little-endian unsigned 32-bit) and `decoded`.

    Words between ASCII white space are encoded once per slice: the vocabulary
    drops white space, so a text's ids are its words' ids. Null and empty texts
    have no ids and decode to nothing; very long texts are slices of their own;
    an empty table stays empty. Columns named `ids` or `decoded` are replaced.
    """
    path = path or default_vocabulary()
    docs = bounded_batches(docs).drop(*[c for c in ("ids", "decoded") if c != text])
    others = [c for c in docs.columns if c != text]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in batches:
            for part in slices(batch, text):
                offsets, words = split_words(part.column(text))
                ids, ends = encode_words(words, offsets, known.encode_list)
                data = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
                bounds = list(zip(ends[:-1].tolist(), ends[1:].tolist()))
                coded = [bytes(data[4 * s : 4 * e]) for s, e in bounds]
                decoded = [known.decode(np.frombuffer(c, dtype="<u4").tolist()) for c in coded]
                yield pa.RecordBatch.from_arrays(
                    [*part.select(others).columns, pa.array(coded, pa.binary()), pa.array(decoded, pa.string())],
                    [*others, "ids", "decoded"],
                )
        give_back()

    schema = docs.select(*others).withColumns({"ids": F.lit(b""), "decoded": F.lit("")}).schema
    return docs.select(*others, text).mapInArrow(code, schema)


def bpe_documents(docs: DataFrame) -> DataFrame:
    return encode_decode(docs.select("doc_id", "text")).select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"),
    )
