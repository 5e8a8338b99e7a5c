"""Token ids of the installed tokenizer library, each different piece of text once.

The vocabulary drops white space, lower-cases, and splits letters from
punctuation. So a text's ids are those of its words one after another, a word
of ASCII may be lower-cased beforehand, and punctuation after a letter or digit
is a piece of its own. What is left to encode are the different pieces that a
Python worker has not met lately.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from tabulens.llm.shared import split_words

#: Words whose ids a Python worker keeps between slices, in each of two generations.
KEPT_WORDS = 100_000
#: Bytes of text that are encoded together: the more, the fewer words are met twice.
SLICE_BYTES = 4 << 20
#: Punctuation that is split off where it ends a word.
TRAILING = ".,;:!?#$%&*|"
#: Lower-case words of precomposed letters, which every step before the merges leaves as one piece.
_LETTERS = re.compile("[a-zà-öø-ÿ]{1,64}")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_signs() -> list[str]:
    """The printable sign for each byte: itself where printable, else from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in own)
    signs = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [signs[b] for b in range(256)]


class Encoder:
    """The library's tokenizer with the ids of words met lately, as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.signs = dict(enumerate(byte_signs()))
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode_new(self, words: list[str]) -> dict[str, bytes]:
        """Words of plain letters go straight to the library's model, others through all its steps."""
        fits, model = _LETTERS.fullmatch, self.tokenizer.model.tokenize
        found: dict[str, bytes] = {}
        other = []
        for word in words:
            if fits(word):
                piece = word if word.isascii() else word.encode("utf-8").decode("latin-1").translate(self.signs)
                found[word] = array("I", [t.id for t in model(piece)]).tobytes()
            else:
                other.append(word)
        for word, encoded in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False)):
            found[word] = array("I", encoded.ids).tobytes()
        return found

    def encode_list(self, words: list[str]) -> list[bytes]:
        """Ids of each word; a word that was not met for a generation is forgotten."""
        young, old = self.young, self.old
        found = list(map(young.get, words))
        unseen = [i for i, data in enumerate(found) if data is None]
        new = self.encode_new([words[i] for i in unseen if words[i] not in old])
        for i in unseen:
            word = words[i]
            data = found[i] = old[word] if word in old else new[word]
            if len(word) <= 64:
                young[word] = data
        if len(young) > KEPT_WORDS:
            self.old, self.young = young, {}
        return found


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def gather(starts: np.ndarray, lengths: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """The pool's stretches `starts[i] : starts[i] + lengths[i]` one after another."""
    ends = np.cumsum(lengths)
    places = np.arange(int(ends[-1]) if len(ends) else 0)
    places += np.repeat(starts - (ends - lengths), lengths)
    return pool[places]


def split_trailing(words: pa.LargeStringArray) -> tuple[pa.LargeStringArray, pa.LargeStringArray]:
    """Each word as (stem, punctuation after it), a stem of ASCII in lower case.

    The vocabulary composes letters before it lower-cases, and some have only a
    small composed form (J with caron), so stems with other signs stay as they are.
    Words with `<` may hold special tokens and stay as they are. Punctuation is
    only split from a letter or digit: after another sign it is the same piece.
    """
    plain = pc.invert(pc.match_substring(words, "<"))
    stems = pc.ascii_rtrim(words, characters=TRAILING)
    split = pc.and_(plain, pc.match_substring_regex(stems, r"[\pL\pN]$"))
    stems = pc.if_else(split, stems, words)
    stems = pc.if_else(pc.and_(plain, pc.string_is_ascii(stems)), pc.ascii_lower(stems), stems)
    whole, size = (pc.binary_length(a).to_numpy(zero_copy_only=False) for a in (words, stems))
    begins = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words)]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    rest = gather(begins + size, whole - size, data)
    ends = np.concatenate(([0], np.cumsum(whole - size)))
    return stems, pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(rest))


def encode_words(words: pa.LargeStringArray, offsets: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and the offsets of the texts in them.

    `encode` gives the ids of each word of a list as little-endian 32-bit bytes.
    """
    coded = words.dictionary_encode()
    stems, rests = split_trailing(coded.dictionary)
    pieces = pa.concat_arrays([stems, rests]).dictionary_encode()
    parts = encode(pieces.dictionary.to_pylist())
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
    pool = np.frombuffer(b"".join(parts), dtype="<u4")
    # The ids of each different word, made of its two pieces, then of all words.
    both = pieces.indices.to_numpy(zero_copy_only=False).reshape(2, -1).T.reshape(-1)
    pool = gather((np.cumsum(sizes) - sizes)[both], sizes[both], pool)
    sizes = sizes[both].reshape(-1, 2).sum(axis=1)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    lengths = sizes[codes]
    ids = gather((np.cumsum(sizes) - sizes)[codes], lengths, pool)
    return ids, np.concatenate(([0], np.cumsum(lengths)))[offsets]


def encode_texts(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The library's ids of each text without special tokens added; null is empty."""
    offsets, words = split_words(texts)
    return encode_words(words, offsets, encoder(path).encode_list)
