"""Language identification against its definition in plain Python, and held-out accuracy."""

import os
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tabulens.llm import language
from tabulens.llm.queries import QUERIES
from tabulens.llm.shared import mixed, table

FOLDER = os.environ.get("TABLES", "/root/testdata/sf0.01")
TEXTS = [
    (1, "The cat and the dog are here.", "en"),
    (2, "Der Hund und die Katze sind hier.", "de"),
    (3, None, "en"),
    (4, "", "de"),
    (5, "12 345 ... !? ́", "en"),
    (6, "wörter " * 40_000, "de"),
    (7, "x" * 300_000, None),
    (None, "the words without an id", "en"),
    (8, "日本語のとても長い文章", "ja"),
    (8, "日本語のとても長い文章", "ja"),
]


@pytest.fixture(scope="module")
def docs(spark):
    clashes = "rank order share buckets weights lang_pred held_out kind n".split()
    rows = [(d, t, lang, *["x"] * len(clashes)) for d, t, lang in TEXTS]
    schema = "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in clashes)
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(7)
    return language.Model(("de", "en"), rng.normal(size=(2, 64)), rng.normal(size=2), 0.7, 0.6)


def plain_logits(text, model):
    """Mean of the scores of all subwords of all words."""
    found = []
    for word in (text or "").split():
        letters = "".join(c for c in word.lower() if c.isalpha() or c == "́")
        if not any(c.isalpha() for c in letters):
            continue
        codes = [np.uint64(ord(c)) for c in f"<{letters}>"]
        for length in language.LENGTHS:
            for i in range(len(codes) - length + 1):
                total = np.zeros(1, np.uint64)
                for code in codes[i : i + length]:
                    total = total * np.uint64(0x9E3779B97F4A7C15) + code
                found.append(int(mixed(total)[0] >> np.uint64(32)) % model.scores.shape[1])
    return (model.scores[:, found].mean(axis=1) + model.offsets if found else None), len(found)


def test_scores_are_means_over_whole_texts(model):
    texts = [t for _, t, _ in TEXTS if not t or len(t) < 1000] + ["ab " * 3000]
    values, counts = language.logits(pa.array(texts, pa.string()), model)
    for text, value, count in zip(texts, values, counts):
        expected, number = plain_logits(text, model)
        assert count == number
        if number:
            assert value == pytest.approx(expected)


def test_chunks_do_not_change_scores(model, monkeypatch):
    texts = pa.array([t for _, t, _ in TEXTS], pa.string())
    whole = language.logits(texts, model)[0]
    monkeypatch.setattr(language, "CHUNK", 7)
    assert np.array_equal(language.logits(texts, model)[0], whole)


def test_edges(spark, docs, model):
    rows = language.identify(docs, model).collect()
    assert len(rows) == len(TEXTS)
    for row in rows:
        if row["doc_id"] in (3, 4, 5):
            assert tuple(row)[1:] == ("und", 0.0, True)
        else:
            assert row["lang_pred"] in model.languages and 0.5 <= row["score"] <= 1
            assert row["rejected"] == (row["score"] < model.accepted)
    assert language.identify(docs.limit(0), model).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs, None).collect()} == {"und"}
    found = language.language_documents(docs).collect()
    assert len(found) == len(TEXTS)
    for row in found:
        known = row["doc_id"] is not None
        assert row["held_out"] == (known and zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0)
    assert language.language_documents(docs.limit(0)).collect() == []


def test_held_out_rows_and_hidden_columns_do_not_matter(spark):
    """Other labels of held-out rows, and other values of lang and source anywhere in a prediction, change nothing."""
    rows = [(i, " ".join(("der die das und" if i % 2 else "the and of it").split()[j % 4] + f"{i}" for j in range(9)), "de" if i % 2 else "en") for i in range(120)]
    changed = [(d, t, "xx" if zlib.crc32(str(d).encode()) % 5 == 0 else lang) for d, t, lang in rows]
    schema = "doc_id long, text string, lang string"
    first, second = (sorted(map(tuple, language.language_documents(spark.createDataFrame(r, schema)).collect())) for r in (rows, changed))
    assert first == second
    assert all((r[2] == "de") == bool(r[0] % 2) for r in first)


def test_sample_is_bounded_and_balanced(spark):
    rows = [(i, "text", "rare" if i % 50 == 0 else "often") for i in range(20_000)]
    found = language.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 200)
    counts = {r["lang"]: r["count"] for r in found.groupBy("lang").count().collect()}
    assert 60 < counts["rare"] < 140 and 60 < counts["often"] < 140


def test_calibration_survives_wrong_labels():
    rng = np.random.default_rng(1)
    sure = np.concatenate([rng.uniform(3, 9, 900), rng.uniform(-0.4, 0.4, 300)])
    values = np.stack([sure, np.zeros(1200)], axis=1)
    right = np.where(rng.random(1200) < 1 / (1 + np.exp(-sure)), 0, 1)
    right[:20] = 1  # wrong labels of sure predictions
    temperature, accepted = language.calibrated(values, right)
    scores = language.softmax(values / temperature).max(axis=1)
    assert (scores[:900] >= accepted).mean() > 0.95 and (scores[900:] < accepted).mean() > 0.95


def test_held_out_accuracy(spark):
    found = QUERIES["op11_language_id"](spark, FOLDER)
    truth = table(spark, FOLDER, "documents").selectExpr("doc_id", "lang")
    rows = found.join(truth, "doc_id").filter("held_out").collect()
    assert len(rows) > 100
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert sum(not r["rejected"] for r in rows) >= 0.9 * len(rows)
