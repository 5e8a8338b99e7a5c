import brute
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabulens.llm import bpe, tokenizing

PATH = tokenizing.default_vocabulary()
LIBRARY = brute.tokenizer()
ALPHABET = st.one_of(
    st.sampled_from("abcXYZéÉßñÿ÷×'0129.,;#$%|<>()-́   \t\n\x0bİΣς中한😀"),
    st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'s", "'re", "the ", "tion"]),
    st.characters(exclude_categories=["Cs"]),
)
WORDS = [
    "<|ENDOFTEXT|>", "a<|endoftext|>b,.", "it's,", "It'S.", "é,", "́,", "),.", "x),.", "İstanbul.", "ß!", "...",
    "1,000.5%", "a b.", "Ünï…,", "don't!!", "''s,", ";,", "≠,", "á.", "x̸.", "≠", "aſ.", "Ⅷ,", "²,",
    "a\U000323b0", "\u1c89x", "ꟋB.", "a\u0558,", "\U00010d50\U00010d70", "\u208f1",
]


#: Capital letters with a mark that only the small letter composes with.
SMALL_ONLY = ["J\u030c", "H\u0331", "T\u0308", "W\u030a", "Y\u030a"]


def ids_of(texts):
    ids, offsets = tokenizing.encode_texts(pa.array(texts, pa.string()), PATH)
    return [ids[s:e].tolist() for s, e in zip(offsets[:-1], offsets[1:])]


def expected(texts):
    return [LIBRARY.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("word", WORDS)
def test_special_words(word):
    texts = [word, f"{word} {word}", f"x {word}", None, ""]
    assert ids_of(texts) == expected(texts)
    assert [bpe.vocabulary(PATH).encode(t or "") for t in texts] == expected(texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(ALPHABET, max_size=20).map("".join), max_size=4))
def test_ids_are_the_library_s(texts):
    assert ids_of(texts) == expected(texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(ALPHABET, max_size=30).map("".join))
def test_own_encoder_and_decoder_agree_with_the_library(text):
    known = bpe.vocabulary(PATH)
    ids = known.encode(text)
    assert ids == LIBRARY.encode(text, add_special_tokens=False).ids
    assert known.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=100, deadline=None)
@given(st.text("abtehinors", min_size=1, max_size=300))
def test_long_and_short_words_merge_alike(word):
    known = bpe.vocabulary(PATH)
    assert known.merge_long(known.parts(word)) == known.merge_short(known.parts(word))


def test_very_long_words():
    word = "thereinthe" * 20_000
    assert bpe.vocabulary(PATH).encode(word) == LIBRARY.encode(word, add_special_tokens=False).ids
    assert ids_of([word, "short"]) == expected([word, "short"])


def test_forgotten_words_are_encoded_again(monkeypatch):
    monkeypatch.setattr(tokenizing, "KEPT_WORDS", 2)
    for texts in (["a b c d e", "f g"], ["a h i", "b c"], ["d e f g h i", ""]):
        assert ids_of(texts) == expected(texts)


@pytest.mark.parametrize("letter", SMALL_ONLY)
def test_letters_are_composed_before_they_are_lower_cased(letter):
    texts = [letter, f"{letter}he", f"a{letter},", f"X{letter}.", letter.lower()]
    assert ids_of(texts) == expected(texts)
    assert [bpe.vocabulary(PATH).encode(t) for t in texts] == expected(texts)
