"""Ranked search against its definition in plain Python."""

import math
import re
from collections import Counter

import pytest

from tabulens.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = [
    (1, "The cat sat on the mat."),
    (2, "the CAT, the cat; the Cat-cat!"),
    (3, None),
    (4, ""),
    (5, " ... !!"),
    (6, "Über über ÜBER naïve café 日本語 cat_cat ca t"),
    (7, "the cat sat on the mat."),
    (7, "the cat sat on the mat."),
    (None, "The cat sat on the mat."),
    (8, "dog " * 300_000 + "cat"),
    (9, "concatenate cats at the\x00cat� mat"),
    (10, "kK KELVIN kelvin İ"),
]
ITEMS = [
    (1, "cat"),
    (2, "The mat, the CAT"),
    (3, None),
    (4, "!!"),
    (5, "über 日本語 naïve"),
    (6, "nowhere"),
    (7, "dog"),
    (7, "mat"),
    (None, "sat on"),
    (8, "ca t kelvin kK"),
]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def expected(docs, items, top=10):
    counts = [(d, Counter(TERM.findall(lower(t)))) for d, t in docs]
    number = sum(bool(c) for _, c in counts)
    total = sum(sum(c.values()) for _, c in counts)
    found = {}
    terms = {}
    for item, text in items:
        terms.setdefault(item, set()).update(TERM.findall(lower(text)))
    for item, wanted in terms.items():
        scored = []
        for doc, c in counts:
            score = 0
            for term in wanted & set(c):
                df = sum(term in other for _, other in counts)
                w = math.floor(1000 * math.log((2 * number + 2) / (2 * df + 1)))
                m = 10 + 90 * sum(c.values()) * number // total
                score += w * (10**9 * c[term] // (1000 * c[term] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        for rank, (score, empty, doc) in enumerate(sorted(scored)[:top], 1):
            found[item, rank] = None if empty else doc, -score
    return found


def result(rows):
    return {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in rows}


@pytest.fixture(scope="module")
def tables(spark):
    clashes = "item rank term score salt n held".split()
    extra = ", ".join(f"{c} string" for c in clashes)
    docs = spark.createDataFrame([(*d, *["x"] * len(clashes)) for d in DOCS], f"doc_id long, text string, {extra}")
    items = spark.createDataFrame([(*i, *["x"] * len(clashes)) for i in ITEMS], f"item_id long, text string, {extra}")
    return docs.repartition(3), items.repartition(2)


def test_ranks_and_scores(tables):
    rows = lexical.search(*tables).collect()
    assert result(rows) == expected(DOCS, ITEMS)
    assert len(rows) == len(expected(DOCS, ITEMS))


@pytest.mark.parametrize("top", [1, 3])
def test_ties_go_to_the_smaller_id_in_small_blocks(tables, monkeypatch, top):
    monkeypatch.setattr(lexical, "SCORES_AT_ONCE", 3)
    rows = lexical.search(*tables, top=top, block_terms=2).collect()
    assert result(rows) == expected(DOCS, ITEMS, top)


def test_many_ties_over_many_tasks(spark):
    docs = [(i * 7 % 1000, "same words here") for i in range(1000)]
    items = [(1, "words"), (2, "other same")]
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(13), spark.createDataFrame(items, "item_id long, text string")
    assert result(lexical.search(*frames).collect()) == expected(docs, items)


def test_a_string_as_item_id(spark, tables):
    items = spark.createDataFrame([("a", "cat"), ("b", None)], "item_id string, text string")
    assert result(lexical.search(tables[0], items).collect()) == expected(DOCS, [("a", "cat")])


def test_empty_tables(tables):
    docs, items = tables
    for rows in (lexical.search(docs.limit(0), items), lexical.search(docs, items.limit(0))):
        assert rows.collect() == [] and rows.columns == ["item_id", "rank", "doc_id", "score"]


def test_long_tables_measure_lengths_exactly():
    import numpy as np

    lengths = np.array([3, 10**6], dtype=np.int64)
    assert lexical.length_measures(lengths, 10**12, 10**15).tolist() == [10 + 270 * 10**12 // 10**15, 10 + 90 * 10**18 // 10**15]
