"""Every query over whole tables, against SQL or the brute-force definitions."""

import os
import zlib
from collections import defaultdict

import brute
import pytest
from compare import connect, differences

import corpus_pipeline
from tabulens.functions.storage import shared_folder
from tabulens.llm.queries import ORACLES, QUERIES
from tabulens.llm.shared import table

FOLDER = os.environ.get("TABLES", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] for r in table(spark, FOLDER, "documents").collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    assert differences(spark, connect(FOLDER), QUERIES[name], ORACLES[name], FOLDER) == []


def test_codec_agrees_with_the_library(spark, documents):
    coder = brute.tokenizer()
    rows = QUERIES["op4_bpe_codec"](spark, FOLDER).collect()
    assert len(rows) == len(documents)
    for row in rows:
        ids = coder.encode(documents[row["doc_id"]], add_special_tokens=False).ids
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == brute.sha(brute.le(ids))
        assert row["decoded_sha256"] == brute.sha(coder.decode(ids, skip_special_tokens=False))


def test_token_files_hold_all_ids(spark, documents):
    coder = brute.tokenizer()
    rows = {r["doc_id"]: r for r in QUERIES["op5_token_orc"](spark, FOLDER).collect()}
    assert sorted(rows) == sorted(documents)
    start = 0
    for doc in sorted(documents):
        ids = coder.encode(documents[doc], add_special_tokens=False).ids + [2]
        assert tuple(rows[doc]) == (doc, start, len(ids), zlib.crc32(brute.le(ids)))
        start += len(ids)


def checked_packing(rows, documents):
    expected = brute.pieces(documents)
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == expected
    assert len(rows) == len(expected)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in bins.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))]
        assert sum(n for _, n in spans) <= 2048
    return len(bins), sum(n for _, n, _ in expected.values()) / 2048


def test_packing_is_whole_and_tight(spark, documents):
    bins, least = checked_packing(QUERIES["op7_best_fit_packing"](spark, FOLDER).collect(), documents)
    assert bins <= least * 1.03 + 1


def staged_folders(spark):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/tabulens")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return {str(s.getPath().getName()) for s in system.listStatus(path)} if system.exists(path) else set()


def test_pipeline_agrees_with_its_stages_by_definition(spark, documents):
    before = staged_folders(spark)
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    # Nothing that the stages wrote for each other or themselves is left.
    assert [n.split("-")[0] for n in staged_folders(spark) - before] == ["best_fit_packing"]
    docs = [tuple(r) for r in table(spark, FOLDER, "documents").select("doc_id", "text", "lang", "source").collect()]
    good = brute.quality([d[1:] for d in docs])
    left = {d[0]: d[1] for d, q in zip(docs, good) if q[-1]}
    keep = brute.exact(left.items())
    left = {d: left[d] for (d, _), (first, _) in keep.items() if d == first}
    left = {d: left[d] for d, (_, root) in brute.components(left, 5, 80).items() if d == root}
    cut = brute.without_repeats(left)
    checked_packing(rows, {d: left[d] if not n else " ".join(ws) for d, (_, n, ws) in cut.items()})
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "exact_dedup", "near_dedup", "substring_dedup", "best_fit_packing"
    ]
