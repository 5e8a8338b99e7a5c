"""Exact duplicates: a two-pass Bloom filter keeps unique rows out of the grouping.

Texts are hashed once, and from then on only (id, hash) is handled. Pass one
hits two slots of a counting Bloom filter per row and keeps the slots that two
or more rows hit. Pass two looks every row up: a row with a slot that only it hit
is unique and passes straight through. Only the others are grouped by SHA-256,
where the counting is exact, so a false alarm of the filter costs time but
changes nothing. A filter that is too large to send to every task is joined by
its words instead; both passes run at every size.

`drop_repeats` then has the ids of the rows that go. A second, folded filter of
them, of a fixed size, is sent to the tasks that read the documents: rows outside
it pass with their texts where they are, the few others are joined.

A key with a large share of the rows would land in one task. There are at most
`HOT` keys with one row in `HOT`, so these are broadcast, and only rows of other
keys are joined by key. Everything is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.functions.storage import stage
from tabulens.llm.shared import one_space, unused

PROBES = 2
SLOTS_PER_ROW = 32
#: Of a filter of ids; one in 64 other ids passes it.
SLOTS_PER_ID = 8
WORD = 64
#: A filter of more words of 64 slots is not broadcast (about 50 bytes each on an executor).
BROADCAST_WORDS = 1_000_000
#: A key is hot if it has at least one row in so many, so there are at most so many hot keys.
HOT = 1000


def text_hash(text: Column) -> Column:
    """SHA-256 of the text with white space runs as one space; null counts as empty."""
    return F.sha2(F.encode(one_space(text), "utf-8"), 256)


def _slots(key: list[Column], count: int) -> list[Column]:
    return [F.pmod(F.xxhash64(*key, F.lit(i)), F.lit(count).cast("long")) for i in range(PROBES)]


def filter_words(keys: DataFrame, key: list[Column], count: int, hits: int) -> DataFrame:
    """The Bloom filter of slots hit at least `hits` times: rows of (probe, word, bits, most), the latter the most hits of a slot."""
    hit = keys.select(F.posexplode(F.array(*_slots(key, count))).alias("probe", "slot"))
    often = hit.groupBy("probe", "slot").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= hits)
    bit = F.expr(f"shiftleft(1L, cast(slot % {WORD} as int))")
    words = often.groupBy("probe", F.expr(f"slot div {WORD}").alias("word"))
    return words.agg(F.bit_or(bit).alias("bits"), F.max("n").alias("most"))


def with_values(rows: DataFrame, key: Column, side: DataFrame, of: str, value: str, hot: Column | None) -> DataFrame:
    """`rows` with the `value` that `side` has for their key, null without one.

    `side` has one row per key `of`. Those that `hot` marks, a bounded number,
    are broadcast, and so are all if it is None. Rows of hot keys take part in
    the join by key under keys that no row has, so they are spread over all tasks.
    """
    taken = list(rows.columns)

    def name(wanted: str) -> str:
        taken.append(unused(wanted, taken))
        return taken[-1]

    first, at, second, place = name("hot_value"), name("hot_key"), name("cold_value"), name("cold_key")
    few = (side if hot is None else side.filter(hot)).select(F.col(of).alias(at), F.col(value).alias(first))
    joined = rows.join(F.broadcast(few), key == F.col(at), "left")
    if hot is None:
        return joined.select(*rows.columns, F.col(first).alias(unused(value, rows.columns)))
    cold = side.filter(~hot).select(F.col(of).cast("string").alias(place), F.col(value).alias(second))
    spread = F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))
    by = name("by")
    joined = joined.withColumn(by, F.when(F.col(at).isNotNull(), spread).otherwise(key.cast("string")))
    joined = joined.join(cold, F.col(by) == F.col(place), "left")
    return joined.select(*rows.columns, F.coalesce(first, second).alias(unused(value, rows.columns)))


def in_filter(rows: DataFrame, key: list[Column], words: DataFrame, count: int, hot: Column | None = None) -> DataFrame:
    """`rows` with a last column that tells whether all slots of the key are in the filter; `hot` as in `with_values`."""
    tested, flag, slots = rows, F.lit(True), _slots(key, count)
    for i in range(PROBES):
        own = words.filter(F.col("probe") == i)
        tested = with_values(tested, F.shiftright(slots[i], 6), own, "word", "bits", hot)
        place = F.pmod(slots[i], F.lit(WORD).cast("long")).cast("int")
        flag &= F.coalesce(F.getbit(F.col(tested.columns[-1]), place) == 1, F.lit(False))
    return tested.select(*rows.columns, flag.alias(unused("again", rows.columns)))


def maybe_among(rows: DataFrame, key: str, ids: DataFrame, of: str) -> DataFrame:
    """`rows` with a last column that is true where `ids` may have the key (null as well), and false only where it has not.

    The filter has at most a million words and is sent to the tasks that read `rows`.
    """
    count = max(WORD, min(BROADCAST_WORDS * WORD // PROBES, ids.count() * SLOTS_PER_ID))
    hit = ids.select(F.posexplode(F.array(*_slots([F.col(of)], count))).alias("probe", "slot"))
    bit = F.expr(f"shiftleft(1L, cast(slot % {WORD} as int))")
    words = hit.groupBy("probe", F.expr(f"slot div {WORD}").alias("word")).agg(F.bit_or(bit).alias("bits"))
    return in_filter(rows, [F.col(key)], words, count)


def possibly_repeated(keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame, int]:
    """The rows whose key may repeat, those whose key certainly does not, and the number of both."""
    rows = keys.count()
    count = max(WORD, rows * SLOTS_PER_ROW)
    words = stage(filter_words(keys, [F.col(key)], count, 2), "filter")
    fits = words.count() <= BROADCAST_WORDS
    flagged = in_filter(keys, [F.col(key)], words, count, None if fits else F.col("most") * HOT >= rows)
    again = F.col(flagged.columns[-1])
    return flagged.filter(again).drop(again), flagged.filter(~again).drop(again), rows


def hashes(docs: DataFrame, text: str, id_column: str) -> DataFrame:
    """(doc_id, text_sha256) of all rows, written once."""
    return stage(docs.select(F.col(id_column).alias("doc_id"), text_hash(F.col(text)).alias("text_sha256")), "hashes")


def judged(maybe: DataFrame, rows: int) -> DataFrame:
    """(text_sha256, doc_id, n, keep_id, group_size) of the different (hash, id) among possibly repeated rows."""
    # Both aggregations combine in each task first, so a hot group sends one row per task.
    copies = maybe.groupBy("text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    groups = copies.groupBy("text_sha256").agg(
        F.min("doc_id").alias("keep_id"), F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("ids")
    )
    facts = groups.select("text_sha256", F.struct("keep_id", "group_size").alias("group"), "ids")
    found = with_values(copies, F.col("text_sha256"), facts, "text_sha256", "group", F.col("ids") * HOT >= max(1, rows))
    return found.select("text_sha256", "doc_id", "n", "group.keep_id", "group.group_size")


def exact_groups(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row per document: id, `text_sha256`, `keep_id`, `group_size`, `kept`.

    Of equal texts the row with the smallest id stays. A row without an id
    stays only in a group without ids. Of repeated rows with the same id and
    text one stays. Null texts are equal to empty ones; texts of any length are
    hashed whole; an empty table stays empty. Other columns do not matter.
    """
    maybe, unique, rows = possibly_repeated(hashes(docs, text, id_column), "text_sha256")
    grouped = judged(maybe, rows).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    first = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    alone = unique.select(
        "doc_id",
        "text_sha256",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
    )
    return grouped.withColumn("kept", first).drop("copy", "n").unionByName(alone)


def drop_repeats(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The rows that stay, with all their columns; nulls and ties as in `exact_groups`.

    Of rows that share id and text but differ elsewhere, any one stays.
    """
    maybe, _, rows = possibly_repeated(hashes(docs, text, id_column), "text_sha256")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    facts = judged(maybe, rows).filter(~stays | (F.col("n") > 1))
    facts = stage(facts.select("doc_id", "text_sha256", stays.alias("stays")), "repeats")
    found = facts.count()
    if not found:
        return docs
    # Rows are told apart by id first: only those that share one with a row that goes are hashed and joined.
    count = max(WORD, min(BROADCAST_WORDS * WORD // PROBES, found * SLOTS_PER_ROW))
    flagged = in_filter(docs, [F.col(id_column)], filter_words(facts, [F.col("doc_id")], count, 1), count)
    maybe_gone = F.col(flagged.columns[-1])
    key, own = (unused(n, [*docs.columns, "gone_id", "gone_sha"]) for n in ("own_sha", "own_id"))
    near = flagged.filter(maybe_gone).select(*docs.columns, text_hash(F.col(text)).alias(key), F.col(id_column).alias(own))

    def same(other: DataFrame) -> Column:
        return near[own].eqNullSafe(other["gone_id"]) & (near[key] == other["gone_sha"])

    named = facts.select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_sha"), "stays")
    left = near.join(named.drop("stays"), same(named), "left_anti")
    twice = named.filter("stays").drop("stays")
    once = near.join(twice, same(twice), "left_semi").dropDuplicates([own, key])
    passed = flagged.filter(~maybe_gone).drop(maybe_gone)
    return passed.unionByName(left.select(*docs.columns)).unionByName(once.select(*docs.columns))


def exact_documents(docs: DataFrame) -> DataFrame:
    return exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def exact_stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    return drop_repeats(docs)


ORACLE = r"""
    SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
    FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
          FROM documents)
    WINDOW g AS (PARTITION BY text_sha256)"""
