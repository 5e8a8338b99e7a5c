"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import zlib

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabulens.llm import bpe, chat, exact, near, packing, pages, quality, substrings, token_files, warc

PASSAGE = " ".join(f"word{i}" for i in range(40))
TEXTS = [
    (1, "Some plain words that are repeated nowhere else in this small table of texts."),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, f"start here {PASSAGE} and end"),
    (6, f"another {PASSAGE} goes on"),
    (6, f"another {PASSAGE} goes on"),
    (7, f"start  here\n{PASSAGE} and end"),
    (8, "x" * 200_000),
    (9, "one two three four five six seven eight nine ten " * 3000),
    (None, f"no id {PASSAGE}"),
    (None, None),
    (10, "Some plain words that are repeated nowhere else in this small table of text"),
    (11, "<|endoftext|> <b>é</b> #### \x00 'll"),
]
CLASHES = "n_words quality salt limit again word0 bits0 text_sha256 keep_id batch n_removed ids decoded wanted node "
CLASHES += "text_sha256_of gone_id gone_sha stays own_id own_sha again_ by hot_key hot_value cold_key cold_value"
CLASHES = CLASHES.split()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, None if d == 5 else "en", "s", len(t or ""), *["x"] * len(CLASHES)) for d, t in TEXTS]
    schema = "doc_id long, text string, lang string, source string, n_chars long, "
    return spark.createDataFrame(rows, schema + ", ".join(f"{c} string" for c in CLASHES)).repartition(3)


def test_quality_rules(docs):
    rows = quality.quality_documents(docs).collect()
    expected = brute.quality([(t, None if d == 5 else "en", "s") for d, t in TEXTS])
    assert sorted(map(str, map(tuple, rows))) == sorted(str((d, *e)) for (d, _), e in zip(TEXTS, expected))
    left = quality.quality_stage(None, docs, "")
    assert left.columns == docs.columns and left.count() == sum(e[-1] for e in expected)


def test_quality_thresholds_follow_the_group(spark):
    plain = [(i, " ".join(f"w{i}x{j}" for j in range(20)), "en", "a") for i in range(200)]
    odd = [(1000, " ".join(f"w{j}#########" for j in range(20)), "en", "a")]
    signs = [(2000 + i, " ".join(f"w{i}x{j}###" for j in range(20)), "en", "b") for i in range(200)]
    frame = spark.createDataFrame(plain + odd + signs, "doc_id long, text string, lang string, source string")
    gone = {r["doc_id"] for r in quality.quality_documents(frame).filter("NOT kept").collect()}
    assert gone == {1000}


def test_quality_counts_no_text_twice_in_a_task(docs):
    for frame in (quality.quality_documents(docs), quality.quality_stage(None, docs, "")):
        frame.collect()
        plan = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("ArrowEvalPython [") == 2  # for the sketches, which are counted once, and for the verdicts


def test_exact_groups(docs):
    rows = exact.exact_documents(docs).collect()
    groups = {}
    for d, t in TEXTS:
        groups.setdefault(brute.sha(brute.SPACES.sub(" ", t or "")), []).append(d)
    assert len(rows) == len(TEXTS)
    for row in rows:
        ids = groups[row["text_sha256"]]
        known = [i for i in ids if i is not None]
        assert (row["keep_id"], row["group_size"]) == (min(known) if known else None, len(ids))
    kept = [r["text_sha256"] for r in rows if r["kept"]]
    assert sorted(kept) == sorted(groups)
    left = exact.drop_repeats(docs)
    assert left.columns == docs.columns
    assert sorted(brute.sha(brute.SPACES.sub(" ", r["text"] or "")) for r in left.collect()) == sorted(groups)


def test_exact_groups_with_a_filter_too_large_to_send(docs, monkeypatch):
    expected = sorted(map(str, exact.exact_documents(docs).collect()))
    monkeypatch.setattr(exact, "BROADCAST_WORDS", 0)
    assert sorted(map(str, exact.exact_documents(docs).collect())) == expected
    assert exact.drop_repeats(docs).count() == sum("kept=True" in e for e in expected)
    # Unique rows still pass outside of the grouping.
    keys = exact.hashes(docs, "text", "doc_id")
    maybe, unique, rows = exact.possibly_repeated(keys, "text_sha256")
    assert rows == len(TEXTS) and maybe.count() + unique.count() == rows
    repeated = sum("group_size=1" not in e for e in expected)
    assert repeated <= maybe.count() <= repeated + 1 and unique.count() > 5


def test_exact_groups_with_hot_texts(spark, monkeypatch):
    """A third of the rows have one text, some of them one id, too; every key counts as hot or none does."""
    rows = [(i if i % 2 else 1, "the same  text" if i % 3 == 0 else f"text {i % 70}") for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    expected = brute.exact(rows)
    for words, hot in ((0, 2), (0, 10**9), (10**6, 2), (0, 20)):
        monkeypatch.setattr(exact, "BROADCAST_WORDS", words)
        monkeypatch.setattr(exact, "HOT", hot)
        found = exact.exact_documents(frame).collect()
        assert len(found) == 600
        assert {(r["doc_id"], r["text_sha256"]): (r["keep_id"], r["group_size"]) for r in found} == expected
        assert sorted(r["text_sha256"] for r in found if r["kept"]) == sorted({h for _, h in expected})
        left = exact.drop_repeats(frame).collect()
        assert sorted(brute.sha(brute.SPACES.sub(" ", r["text"])) for r in left) == sorted({h for _, h in expected})
        assert {(r["doc_id"], brute.sha(brute.SPACES.sub(" ", r["text"]))) for r in left} <= {(k, h) for (_, h), (k, _) in expected.items()}


def test_substrings(docs):
    rows = substrings.remove_repeats(docs).collect()
    assert len(rows) == len(TEXTS)
    by_id = {(r["doc_id"], r["n_removed"]): r for r in rows}
    assert by_id[5, 0]["text"] == dict(TEXTS)[5]
    assert {r["n_removed"] for r in rows if r["doc_id"] == 6} == {40, 43}  # the second of the equal rows goes whole
    assert by_id[7, 44]["text"] == "" and by_id[None, 40]["text"] == "no id"
    first = brute.without_repeats({9: dict(TEXTS)[9]})[9]
    assert by_id[9, first[1]]["text"] == " ".join(first[2])
    assert by_id[2, 0]["text"] is None and by_id[2, 0]["n_words"] == 0
    left = substrings.substring_stage(None, docs, "")
    assert left.columns == docs.columns and left.dtypes == docs.dtypes
    assert all(r["n_chars"] == len(r["text"] or "") for r in left.collect())


def test_substrings_in_many_small_batches(spark, monkeypatch):
    import random

    rng = random.Random(3)
    parts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(30)) for _ in range(12)]
    rows = {i: " ".join(rng.choice(parts) if rng.random() < 0.5 else f"u{i}v{j}" for j in range(12)) for i in range(150)}
    monkeypatch.setattr(substrings, "BATCH_CHARS", 4000)
    monkeypatch.setattr(substrings, "INDEX_ENTRIES", 50)
    found = substrings.remove_repeats(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()
    expected = brute.without_repeats(rows)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in found} == {d: e[:2] for d, e in expected.items()}
    assert all(r["text"].split() == expected[r["doc_id"]][2] for r in found)


def test_near_groups(docs):
    rows = near.near_documents(docs).collect()
    # A row without an id links others like any row, but gives no component its id.
    expected = brute.components({10**9 if d is None and t else d: t for d, t in TEXTS}, 3, 85)
    assert len(rows) == len(TEXTS)
    for row in rows:
        if row["doc_id"] is not None:
            assert (row["n_shingles"], row["component_id"]) == expected[row["doc_id"]]
        assert row["kept"] == (row["doc_id"] == row["component_id"])
    left = near.near_stage(None, docs, "")
    assert left.columns == docs.columns


def test_nodes_of_one_component_never_meet(spark, monkeypatch):
    """A band of 3000 nodes of one root and a few others makes pairs in proportion, over several salts."""
    rows = [("hot", f"n{i:04}", "r1") for i in range(3000)] + [("hot", f"m{i}", f"r{2 + i % 2}") for i in range(4)]
    rows += [("alone", f"n{i:04}", "r1") for i in range(3000)] + [("small", "x", "r8"), ("small", "y", "r9")]
    members = spark.createDataFrame(rows, "band string, node string, root string").repartition(7)
    found = [tuple(r) for r in near.across_roots(members, F.lit(True)).collect()]
    outer = [(f"m{i}", f"r{2 + i % 2}") for i in range(4)]
    expected = {(f"n{i:04}", m) for i in range(3000) for m, _ in outer} | {("x", "y")}
    expected |= {(a, b) for a, r in outer for b, q in outer if r < q}
    assert len(found) == len(expected) and set(found) == expected
    monkeypatch.setattr(near, "SALTED", 1)
    assert set(map(tuple, near.across_roots(members, F.lit(True)).collect())) == expected


def test_a_third_of_the_rows_are_edits_of_one_text(spark):
    """Different one-word edits of one text, and other texts that share many of its words."""
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:30] + [f"edit{i}"] + base[31:])) for i in range(300)]
    rows += [(1000 + i, " ".join(base[:36] + [f"own{i}x{j}" for j in range(24)])) for i in range(5)]
    rows += [(2000 + i, " ".join(f"v{i}x{j}" for j in range(20))) for i in range(600)]
    found = near.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    expected = brute.components(dict(rows), 5, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == expected


def test_near_stage_drops_exactly_the_rows_judged(spark):
    def text(name, changed=0):
        return " ".join([f"{name}{i}" for i in range(60)] + [f"{name}new{i}" for i in range(changed)])

    rows = [
        (1, text("a")), (None, text("a", 1)), (None, text("b")), (None, None),  # only the second is a near copy
        (2, text("c")), (3, text("c", 1)), (3, text("d")),  # one of two texts that share an id is
        (None, text("e")), (None, text("e", 1)), (None, text("E")),  # no ids: one of the group stays
        (4, text("f")), (4, text("f", 1)), (5, text("g")), (5, text("g")),  # the same id twice
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = sorted((r["doc_id"] or 0, (r["text"] or "none ").split()[0][0].lower()) for r in near.near_stage(None, frame, "").collect())
    assert left == [(0, "b"), (0, "e"), (0, "n"), (1, "a"), (2, "c"), (3, "d"), (4, "f"), (5, "g")]


@pytest.mark.parametrize("rare", [0, 2, 20])
def test_near_groups_of_many_edited_copies(spark, monkeypatch, rare):
    import random

    rng = random.Random(rare)
    base = [f"w{i}" for i in range(120)]
    rows = {}
    for i in range(300):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(120)] = rng.choice([f"e{i}x{rng.random()}", "common"])
        rows[i] = " ".join(words)
    monkeypatch.setattr(near, "RARE", rare)
    found = near.near_documents(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {d: c for d, (_, c) in brute.components(rows, 3, 85).items()}


def test_codec(docs):
    rows = bpe.encode_decode(docs).collect()
    coder = brute.tokenizer()
    expected = sorted(brute.le(coder.encode(t or "", add_special_tokens=False).ids) for _, t in TEXTS)
    assert sorted(bytes(r["ids"]) for r in rows) == expected
    assert set(bpe.encode_decode(docs).columns) == set(docs.columns) - {"text"} | {"ids", "decoded"}


def test_token_files_and_their_pruning(spark, docs, tmp_path):
    token_files.write_tokens(docs, str(tmp_path / "t"))
    rows = token_files.read_tokens(spark, str(tmp_path / "t"))
    assert rows.count() == len(TEXTS)
    found = token_files.positions(rows).orderBy("start").collect()
    assert [r["start"] for r in found] == [sum(x["n_tokens"] for x in found[:i]) for i in range(len(found))]
    ids = [r["doc_id"] for r in found]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    some = token_files.read_tokens(spark, str(tmp_path / "t"), [7, 99])
    assert [r["doc_id"] for r in some.collect()] == [7]
    assert "In(doc_id, [7,99])" in some._jdf.queryExecution().toString()


def test_packing(docs):
    rows = packing.pack(docs).collect()
    assert sum(r["length"] for r in rows) == sum(
        len(brute.tokenizer().encode(t or "", add_special_tokens=False).ids) + 1 for _, t in TEXTS
    )
    assert max(r["offset"] + r["length"] for r in rows) <= 2048


@pytest.mark.parametrize("sizes", [[], [5], [2048, 2048], [1500, 548, 500, 48, 1], list(range(1, 400))])
def test_best_fit_is_whole(sizes):
    bins = packing.best_fit(sizes, 2048)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 2048 for b in bins)
    assert len(bins) <= -(-sum(sizes) // 2048) * 11 / 9 + 1


def test_packing_in_small_runs(docs, monkeypatch):
    monkeypatch.setattr(packing, "RUN_PIECES", 2)
    monkeypatch.setattr(packing, "RUN_BINS", 2)
    rows = packing.pack(docs.repartition(40)).collect()
    assert len(rows) == packing.pack(docs).count()
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in bins.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))]


@pytest.mark.parametrize("seed", range(20))
def test_bins_that_go_up_keep_all_items(seed):
    import random

    rng = random.Random(seed)
    sizes = [rng.choice([rng.randint(1, 2048), rng.randint(900, 1200), 1, 7]) for _ in range(rng.randint(0, 400))]
    for last in (False, True):
        bins = list(packing.bins_of(sizes, 2048, last))
        assert sorted(i for members, _, _ in bins for i in members) == list(range(len(sizes)))
        for members, fill, done in bins:
            assert fill == sum(sizes[i] for i in members) <= 2048
            assert done == (last or fill >= 2044)
            assert done or 2 * fill <= 2048 or len(members) == 1


def test_bins_move_up_a_tree(spark, monkeypatch):
    """Bins of 12 tasks, two to a task of the next level: four levels, bins within bins within bins."""
    monkeypatch.setattr(packing, "FAN", 2)
    levels = []
    staged = packing.stage
    monkeypatch.setattr(packing, "stage", lambda df, name: levels.append(staged(df, name)) or levels[-1])
    fills = {node << packing.TASK_BITS: 85 for node in range(12)}
    bins = spark.createDataFrame([(b, f, b >> packing.TASK_BITS) for b, f in fills.items()], "bin long, fill long, node long")
    moves = {r["bin"]: (r["holder"], r["shift"]) for r in packing.merge_bins(bins).collect()}
    assert len(levels) == 4
    holder = (set(fills) - set(moves)).pop()  # one bin holds the eleven others
    assert {h for h, _ in moves.values()} == {holder}
    assert sorted(s for _, s in moves.values()) == [85 * i for i in range(1, 12)]
    held = [{r["bin"]: r["holder"] for r in level.filter("bin <> holder").collect()} for level in levels]
    assert sum(map(len, held)) == 11 and all(held)
    assert any(into in held[1] for into in held[0].values())  # a bin that holds another one is moved itself


def test_packing_pairs_pieces_of_far_partitions(spark):
    rows = [(i, "the " * (1099 if i < 40 else 899)) for i in range(80)]
    found = packing.pack(spark.createDataFrame(spark.sparkContext.parallelize(rows, 20), "doc_id long, text string")).collect()
    assert {r["length"] for r in found} == {1100, 900}
    assert len({r["sequence_id"] for r in found}) == 40
    assert all({r["offset"] for r in found if r["length"] == n} == {o} for n, o in ((1100, 0), (900, 1100)))


def test_archives_with_repeated_and_null_rows(spark):
    long = "é" * 600
    rows = [(1, "u1", long), (2, "u2", long), (2, "u2", long), (3, None, None), (None, "u", long), (4, "a\r\nb", "short"), (5, "b", "short")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = sorted(map(tuple, warc.warc_pages(frame).collect()), key=str)
    digest = __import__("hashlib").sha1(long.encode()).hexdigest()
    assert sum(r[3] == "response" and r[2] == digest and r[0] == 2 for r in found) == 1
    assert [(r[0], r[4]) for r in found if r[3] == "revisit"] == [(1, 2), (2, 2)]
    assert len(found) == len(rows) and all(r[1] == 1200 for r in found if r[2] == digest)


def record(body, kind="response"):
    digest = __import__("hashlib").sha1(body).hexdigest()
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def test_salvage_goes_on_after_damage():
    a, b, c = record(b"one"), record(b"two WARC/1.1\r\n inside"), record(b"three")
    whole = list(warc.salvage(a + b + c))
    assert [r[3] for r in whole] == [b"one", b"two WARC/1.1\r\n inside", b"three"]
    for damaged in (b.replace(b"two", b"2wo"), b[:-9], b[5:], b"junk", b.replace(b"Content-L", b"Content L")):
        found = list(warc.salvage(a + damaged + c))
        assert [r[3] for r in found if r[2] is not None] == [b"one", b"three"]
        gaps = [(r[0], r[1]) for r in found if r[2] is None]
        assert sum(n for _, n in gaps) == len(damaged) and gaps[0][0] == len(a)
    assert list(warc.salvage(b"")) == []


def gzip_members(count, size):
    import gzip
    import random

    rng = random.Random(count)
    blocks = [rng.randbytes(size) for _ in range(count)]
    return [gzip.compress(b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (len(b), b)) for b in blocks], blocks


def test_bytes_fed_grow_with_the_archive(monkeypatch):
    """Twice the members, twice the bytes that are decompressed; false starts of members cost little."""
    fed = {}
    for count in (40, 80, 160):
        members, blocks = gzip_members(count, 10_000)
        members[count // 2] = members[count // 2][:5000] + b"\x1f\x8b\x08" * 50 + members[count // 2][5150:]
        data = b"".join(members)
        with monkeypatch.context() as patched:
            real = zlib.decompressobj
            patched.setattr(zlib, "decompressobj", lambda *a, n=count: Counting(real(*a), fed, n))
            found = list(warc.salvage(data))
        assert [f[3] for f in found if f[2] is not None] == [b for i, b in enumerate(blocks) if i != count // 2]
        gaps = [f for f in found if f[2] is None]
        assert [(g[0], g[1]) for g in gaps] == [(len(b"".join(members[: count // 2])), len(members[count // 2]))]
    assert fed[80] < 2.2 * fed[40] and fed[160] < 2.2 * fed[80]


class Counting:
    """A decompressor that counts the bytes it gets."""

    def __init__(self, inner, fed, key):
        self.inner, self.fed, self.key = inner, fed, key

    def decompress(self, data):
        self.fed[self.key] = self.fed.get(self.key, 0) + len(data)
        return self.inner.decompress(data)

    def __getattr__(self, name):
        return getattr(self.inner, name)


def test_headers_without_end_are_read_once():
    data = b"WARC/1.1\r\nA: b\r\n" * 20_000
    assert [(f[0], f[1]) for f in warc.salvage(data)] == [(0, len(data))]


def test_archives_of_long_pages_are_bounded(spark, tmp_path):
    rows = [(i, f"u{i}", ("x" * (200_000 if i % 10 == 0 else 3_000_000 if i == 5 else 50)) + str(i), "clash") for i in range(60)]
    schema = "page_id long, url string, html string, payload string"
    pages_ = spark.createDataFrame(rows, schema).coalesce(1)
    path = str(tmp_path / "archives")
    warc.write_archives(pages_, path, per_file=20, file_bytes=1_000_000)
    sizes = [f.stat().st_size for f in (tmp_path / "archives").glob("*.txt")]
    assert max(sizes) < 3_100_000 and sum(s > 1_300_000 for s in sizes) == 1
    found = {r["page_id"]: r for r in warc.read_archives(spark, path).collect()}
    assert {i: r["payload"].decode() for i, r in found.items()} == {r[0]: r[2] for r in rows}
    clash = pages_.toDF("page_id", "url", "html", "record_type")
    assert warc.warc_pages(clash).count() == 60


def test_salvage_of_gzip_members():
    import gzip

    members = [gzip.compress(record(x)) for x in (b"one", b"two", b"three")]
    broken = members[1][:-12] + b"\x00" * 12
    found = list(warc.salvage(members[0] + broken + members[2]))
    assert [r[3] for r in found if r[2] is not None] == [b"one", b"three"]
    assert [(r[0], r[1]) for r in found if r[2] is None] == [(len(members[0]), len(broken))]


def test_chat_of_nulls_ties_and_control_strings(spark):
    rows = [
        (1, 0, "user", "a<|end|>&lt;"), (1, 1, "assistant", None), (1, 2, "assistant", "<|assistant|>x|&amp;"),
        (1, 2, "assistant", "<|assistant|>x|&amp;"), (1, None, None, "late"), (None, 0, "user", ""), (2, 0, "a|b<c", "x" * 100_000),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: r for r in chat.chat_conversations(frame).collect()}
    assert set(found) == {1, 2, None, -7}
    assert found[1]["n_turns"] == 5 and found[2]["n_turns"] == 1 and found[None]["n_turns"] == 1
    loss = "<|assistant|>x|&amp;" * 2
    assert (found[1]["loss_chars"], found[1]["loss_sha256"]) == (len(loss), brute.sha(loss))
    said = "user\na<|end|>&lt;\nassistant\n\nassistant\n<|assistant|>x|&amp;\nassistant\n<|assistant|>x|&amp;\n\nlate\n"
    assert found[1]["turns_sha256"] == brute.sha(said)
    assert found[2]["turns_sha256"] == brute.sha("a|b<c\n" + "x" * 100_000 + "\n")


def test_events_fold_into_the_last_version(spark):
    log = [(1, 0, "m", i, k, "assistant", t) for i, (k, t) in enumerate(
        [("open", None), ("delta", "a"), ("edit", "b"), ("delta", "c"), ("regenerate", None), ("delta", "d"), ("delta", None),
         ("delta", "e"), ("strange", "z")])]
    frame = spark.createDataFrame(log, "conv_id long, turn long, message string, seq long, kind string, role string, text string")
    assert [tuple(r) for r in chat.fold_events(frame).collect()] == [(1, 0, "m", "assistant", "de")]


PAGES = [
    ("<article><h1>T</h1><p>a&amp;b <b>c</b>d</p></article><footer>no no</footer>", "T\na&b cd"),
    ("<body><nav><a>menu words here</a></nav><div class='content'><p>One two three.</p><div class=ad>buy now</div>"
     "<p>Four.</p></div><div id='comments'><p>nice article says reader</p></div></body>", "One two three.\nFour."),
    ("<main><header>x</header><p>keep<script>var a='</p>'</script> this</p><form>mail</form><p>and\n that</p></main>"
     "<aside>side words and more</aside>", "keep this\nand that"),
    ("<html><head><title>t</title></head><body>just text<br>more", "just text\nmore"),
    ("<article><p>start<aside>related links and more and more words</aside><p>end</article>", "start\nend"),
    ("no tags at all", "no tags at all"), ("", ""), (None, ""), ("<p></p><nav>x</nav>", ""), ("a < b &lt; c", "a < b < c"),
    ("<article><ul><li>one</li><li>two</li></ul><p>x <!-- <p>no</p> --> y</article><div class=\"cookie-notice\">ok</div>", "one\ntwo\nx y"),
]


@pytest.mark.parametrize("html,text", PAGES)
def test_main_text(html, text):
    assert pages.main_text(html or "", {}) == text


RAW_PAGES = [
    ("<article><p>one</p><svg-icon name=x></svg-icon><p>two</p></article>", "one\ntwo"),
    ("<p>one</p><svg/><p>two</p>", "one\ntwo"), ("<p>one</p><math display='a>b' /><p>two</p>", "one\ntwo"),
    *[(f"<p>one</p><{name}>x</{name}><p>two</p>", "one\nx\ntwo") for name in ("select-menu", "title-bar", "template-x", "object-x")],
    ("<p>one</p><object data=x><p>two</p><object data=y><p>three</p>", "one\ntwo\nthree"),
    ("<p>one</p><SVG viewBox='0'><text>no</text></svg ><p>two</p>", "one\ntwo"),
    ("<p>one</p><svg/><svg><text>no</text></svg><p>two</p>", "one\ntwo"),
    ("<p>one</p><script>var a = '<p>no</p>'", "one"),
]


@pytest.mark.parametrize("html,text", RAW_PAGES)
def test_raw_elements_end_where_they_end(html, text):
    assert pages.main_text(html, {}) == text


STORY = "<article><p>The whole story is told here.</p><p>And it ends.</p></article>"
PLAIN = "<p>The whole story is told here.</p><p>And it ends.</p>"
WRAPPED = [
    *[f"<div class='{name}'>{STORY}</div>" for name in ("post has-sidebar", "no-sidebar")],
    *[STORY.replace("<article>", f"<article class='{name}'>") for name in ("long-form", "comments-open")],
    f"<main><div class='post has-sidebar'>{STORY}</div><div id='comments'><p>{'So many words of readers. ' * 9}</p></div></main>",
    f"<main class='search-results'>{STORY}</main>", f"<form id='aspnetForm'><nav>some menu</nav>{STORY}</form>",
    f"<div class='no-sidebar'>{PLAIN}<div class='sidebar'>read this too</div></div>",
    f"<form id='aspnetForm'><nav>some menu</nav>{PLAIN}</form>", f"<div class='md hidden-xs'>{PLAIN}</div>",
    f"<div id='discussion'>{PLAIN}</div>", f"<div class='related'><article>A teaser.</article></div>{STORY}",
    f"<div>{PLAIN}</div><div id='comments'><p>{'So many words of readers follow. ' * 9}</p></div>",
    f"<div class='post has-sidebar'>{STORY}<div id='comments'><p>{'So many words of readers follow. ' * 9}</p></div></div>",
]


@pytest.mark.parametrize("html", WRAPPED)
def test_names_of_wrappers_do_not_empty_a_page(html):
    assert pages.main_text(html, {}) == "The whole story is told here.\nAnd it ends."


def test_marked_pages_teach_what_unmarked_pages_hold(spark):
    menu = "<ul>" + "<li><a href=x>go there</a></li>" * 8 + "</ul>"
    talk = "<div class='reader-says'><p>I do not think so at all.</p></div>"
    story = "".join(f"<p>Sentence {i} of the story is here.</p>" for i in range(6))
    marked = [(i, "u", f"<body>{menu}<article><h1>T</h1>{story}</article>{talk * 5}</body>") for i in range(8)]
    plain = f"<body>{menu}<div><h1>T</h1>{story}</div>{talk * 5}</body>"
    weights = pages.fit_weights(spark.createDataFrame(marked, "page_id long, url string, html string"))
    wanted = "\n".join(["T", *(f"Sentence {i} of the story is here." for i in range(6))])
    assert pages.main_text(marked[0][2], weights) == wanted
    assert pages.main_text(plain, weights) == wanted != pages.main_text(plain, {})
    # More observations move a weight, and content may teach that a listed name is content.
    assert pages.weigh("word:li/links", 1, 10) > pages.weigh("word:li/links", 1, 100) < 0 < pages.weigh("word:p~form", 99, 1)


def folded(spark, events):
    schema = "conv_id long, turn long, message string, seq long, kind string, role string, text string, said string"
    frame = spark.createDataFrame([(*e, "clash") for e in events], schema).repartition(3)
    return sorted((tuple(r) for r in chat.fold_events(frame).collect()), key=str)


def test_logs_as_they_come(spark):
    log = [
        (1, 0, "q", 1, "open", "user", None),
        (1, 0, None, 2, "delta", None, "first "),
        (1, 0, None, 3, "delta", None, "words"),
        (1, 1, "a", 4, "open", "assistant", None),
        (1, 1, None, 5, "delta", None, "answ"),
        (1, 1, None, 6, "delta", None, "er"),
        (1, 0, "q", 7, "edit", None, "other words"),
        (1, 1, "a", 8, "regenerate", None, None),
        (1, 1, None, 9, "delta", None, "new "),
        (1, 1, "a", 10, "unknown", None, "nothing"),
        (1, 1, None, 11, "delta", None, "answer"),
    ]
    expected = [(1, 0, "q", "user", "other words"), (1, 1, "a", "assistant", "new answer")]
    assert folded(spark, log) == expected
    # Order of rows and repeated deliveries change nothing.
    assert folded(spark, log[::-1] + log[3:9] * 2) == expected
    # A log that starts in the middle has no role, and its first parts have no message.
    assert folded(spark, log[4:]) == [(1, 0, "q", None, "other words"), (1, 1, "a", None, "new answer"), (1, 1, None, None, "answer")]
    assert folded(spark, [(2, None, "m", None, "delta", None, "a"), (None, 1, "m", 1, "delta", None, None)]) == [
        (2, None, "m", None, "a"), (None, 1, "m", None, ""),
    ]
    rendered = chat.render(spark.createDataFrame(expected, "conv_id long, turn long, message string, role string, text string"))
    assert rendered.first()["formatted"] == "<|user|>other words<|end|><|assistant|>new answer<|end|>"


def test_conversations_with_clashing_columns(spark):
    rows = [(1, 0, "user", "a", "x", "x", "x"), (1, 0, "user", "a", "x", "x", "x"), (1, 1, "assistant", "b", "x", "x", "x")]
    said = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq string, message string, e string")
    found = {r["conv_id"]: r for r in chat.chat_conversations(said).collect()}
    assert found[1]["n_turns"] == 3 and found[1]["turns_sha256"] == brute.sha("user\na\nuser\na\nassistant\nb\n")
    assert found[1]["loss_sha256"] == brute.sha("b")


STORY_ONLY = "The whole story is told here.\nAnd it ends."
SEVERAL = [
    f"<main>{STORY}</main><section>" + "".join(f"<article><a href=x>Other story {i} of today</a></article>" for i in range(4)) + "</section>",
    f"<main>{STORY}<section>" + "".join(f"<article><a href=x>Other story {i} of today</a></article>" for i in range(4)) + "</section></main>",
    f"<div>{STORY}</div><div id='reactions'><article class='comment'><p>I do not think so at all.</p></article></div>",
    STORY.replace("</article>", "<article class='comment'><p>I do not think so.</p></article></article>"),
]


@pytest.mark.parametrize("html", SEVERAL)
def test_teasers_and_comments_marked_as_articles(html):
    assert pages.main_text(html, {}) == STORY_ONLY


def test_several_posts_are_all_content():
    posts = "".join(f"<article class='post'><h2>Day {i}</h2><p>Some words of that day, {i}.</p></article>" for i in range(3))
    wanted = "\n".join(f"Day {i}\nSome words of that day, {i}." for i in range(3))
    assert pages.main_text(f"<nav>menu</nav>{posts}", {}) == wanted


def test_link_lists_without_any_labelled_page():
    menu = "<ul>" + "".join(f"<li><a href={i}>{t}</a></li>" for i, t in enumerate(("Home", "About us", "Contact"))) + "</ul>"
    html = f"<body>{menu}<h1><a href=x>The title</a></h1><p>The story with <a href=y>a link</a> in it is told here.</p>{menu}</body>"
    assert pages.main_text(html, {}) == "The title\nThe story with a link in it is told here."


def test_pages_long_repeated_and_with_clashing_columns(spark):
    long = "<article>" + "".join(f"<p>Sentence {i} of it.</p>" for i in range(60_000)) + "</article>"
    rows = [(1, "u", long, "x", "x"), (2, "v", STORY, "x", "x"), (2, "v", STORY, "x", "x"), (2, "v", STORY, "x", "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string, h string")
    found = pages.page_texts(frame).collect()
    assert sorted(r["n_chars"] for r in found)[:3] == [len(STORY_ONLY)] * 3
    assert max(r["n_chars"] for r in found) == sum(len(f"Sentence {i} of it.") + 1 for i in range(60_000)) - 1
    # Repeated rows of a page teach no more than one of them.
    assert pages.fit_weights(frame.filter("page_id = 2")) == pages.fit_weights(frame.filter("page_id = 2").limit(1))


def test_page_texts_with_fitted_weights(spark):
    frame = spark.createDataFrame([(i, "u", h) for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string")
    assert [r["text"] for r in pages.page_texts(frame).orderBy("page_id").collect()] == [t for _, t in PAGES]


def test_empty_tables(spark, docs, tmp_path):
    none = docs.filter("false")
    for function in (quality.quality_documents, exact.exact_documents, substrings.substring_documents, near.near_documents,
                     bpe.bpe_documents, token_files.token_file_documents, packing.packed_documents):
        assert function(none).count() == 0, function
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0
    html = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.warc_pages(html).count() == 0 and pages.page_texts(html).count() == 0
    said = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert [r["conv_id"] for r in chat.chat_conversations(said).collect()] == [-7]


def test_a_round_of_stars_moves_each_edge_three_times(spark):
    from tabulens.llm import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long")
    stars = components._towards_least(components._towards_least(edges, True), False)
    plan = stars._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3, plan
    assert {tuple(r) for r in components.least_nodes(edges).collect()} == {(i, 0) for i in range(1, 51)}


def test_near_nodes_are_longs_and_other_texts_stay_out_of_the_join(spark, monkeypatch):
    made = {}

    def kept(frame, name):
        made.setdefault(name, []).append(stage(frame, name))
        return made[name][-1]

    stage = near.stage
    monkeypatch.setattr(near, "stage", kept)
    rows = [(i, " ".join(f"u{i}x{j}" for j in range(30))) for i in range(2000)]
    rows += [(None, "a b c d e f"), (None, None), (7, "a b c d e f"), (3000, rows[5][1] + " more"), (3000, "g h i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in near.near_documents(docs).collect()}
    assert found[3000, 29] == 5 and found[3000, 1] == 3000 and found[None, 4] == 7 and found[None, 0] is None
    assert all(c == d for (d, _), c in found.items() if d is not None and d < 2000)
    assert dict(made["nodes"][0].dtypes)["node"] == dict(made["links"][0].dtypes)["a"] == "bigint"
    ids = made["wanted"][0]
    assert {r["wanted"] for r in ids.collect()} == {5, 3000}
    flagged = exact.maybe_among(docs, "doc_id", ids.union(spark.sql("SELECT null")), "wanted")
    passed = {r["doc_id"] for r in flagged.filter(flagged.columns[-1]).collect()}
    assert passed >= {5, 3000, None} and len(passed) < 300


def test_no_plan_of_near_duplicates_has_many_shuffles(spark, monkeypatch):
    """The driver follows the shuffles of a plan at once, whatever the size of the table."""
    base = [f"w{i}" for i in range(60)]
    edited = [" ".join(["x"] * (i % 3) + [w if j % 20 != i % 20 else f"e{i}" for j, w in enumerate(base)]) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(edited)), "doc_id long, text string")
    shuffles, stage = {}, near.stage

    def counted(df, name):
        plan = df._jdf.queryExecution().executedPlan().toString()
        shuffles[name] = max(shuffles.get(name, 0), plan.count("Exchange hashpartitioning"))
        return stage(df, name)

    monkeypatch.setattr(near, "stage", counted)
    near.near_documents(docs).collect()
    assert {"pairs", "links"} <= set(shuffles) and max(shuffles.values()) <= 12, shuffles
