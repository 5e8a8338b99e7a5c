"""Quality rules with thresholds that follow the corpus.

Four rates of each document are compared with the document's language and
source. The thresholds come from mergeable quantile sketches: counts of the
values in buckets that are exact up to 63 and below 1/32 of the value beyond.
Adding two sketches' counts gives the sketch of both inputs, so tasks
pre-aggregate, no order or sampling enters, and a rerun gives the same rows.

A group of fewer than `min_docs` documents is judged by its language, a small
language by the whole corpus; their sketches are sums of the groups' sketches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens.llm.shared import bounded_batches, give_back, inside, rolling, slices, split_words, texts_of, unused, word_hashes

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5
SYMBOLS = "#*$%&|<>"
MIN_DOCS = 100
FENCE = 3
SALTS = 16
EXACT = 64

#: Rates per 1000: the least spread that counts, and which sides are fenced.
RATES = {
    "word_length": (500, True, True),
    "symbols": (50, False, True),
    "dup_lines": (100, False, True),
    "repeats": (50, False, True),
}


def repeated_window_words(hashes: np.ndarray, offsets: np.ndarray, length: int) -> np.ndarray:
    """Words per text that lie in a window found at least twice in the same text."""
    count = len(offsets) - 1
    valid = inside(offsets, length)
    starts = np.nonzero(valid)[0]
    if not len(starts):
        return np.zeros(count, dtype=np.int64)
    keys = rolling(hashes[:, 0], length)[starts]
    owner = np.repeat(np.arange(count), np.diff(offsets))
    order = np.lexsort((keys, owner[starts]))
    keys, starts = keys[order], starts[order]
    same = np.zeros(len(keys) + 1, dtype=bool)
    same[1:-1] = (keys[1:] == keys[:-1]) & (owner[starts[1:]] == owner[starts[:-1]])
    again = starts[same[1:] | same[:-1]]
    cover = np.zeros(len(owner) + 1, dtype=np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + length, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(cover[:-1]) > 0)))
    return covered[offsets[1:]] - covered[offsets[:-1]]


def _counts(texts: pa.Array) -> pa.StructArray:
    offsets, words = split_words(texts)
    repeats = repeated_window_words(word_hashes(words), offsets, REPEAT_WINDOW)
    n_words = np.diff(offsets)
    rows = texts_of(texts).to_pylist()
    lengths = np.concatenate(([0], np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False))))
    chars = lengths[offsets[1:]] - lengths[offsets[:-1]]
    symbols = np.fromiter((sum(map(t.count, SYMBOLS)) for t in rows), dtype=np.int64, count=len(rows))
    lines = np.zeros((len(rows), 2), dtype=np.int64)
    for i, text in enumerate(rows):
        with_word = [x for x in text.split("\n") if x.strip(" \t\r\v\f")]
        lines[i] = len(with_word), len(with_word) - len(set(with_word))
    columns = [n_words, chars, symbols, lines[:, 0], lines[:, 1], repeats]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], COUNTS)


COUNTS = "n_words word_chars n_symbols n_lines n_dup_lines n_repeat_words".split()


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def text_counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Counts of each text; null counts as a text without words."""
    for texts in batches:
        frame = pa.table({"text": texts})
        done = [_counts(s.column("text")) for s in slices(frame, "text")]
        yield pa.concat_arrays(done) if done else _counts(texts)
    give_back()


#: As it is not called deterministic, no filter on the counts is pushed below them: that
#: would count every text twice, with two workers to a task.
text_counts = text_counts.asNondeterministic()


def bucket(value: Column) -> Column:
    """The smallest value of the sketch bucket: exact below 64, then 32 to 64 steps per doubling."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    width = F.call_function("shiftleft", F.lit(1).cast("long"), shift)
    return value - value % width


def measured(docs: DataFrame, text: str, name: str) -> DataFrame:
    """The table with a struct `name` of counts, rates and whether the fixed rules fail."""
    c = lambda field: F.col(f"{name}.{field}")
    rate = lambda part, whole: F.when(c(whole) > 0, F.expr(f"1000 * {name}.{part} div {name}.{whole}")).otherwise(0)
    failed = (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * c("n_words"))
    counted = bounded_batches(docs).withColumn(name, text_counts(F.col(text)))
    return counted.withColumn(
        name,
        F.struct(
            f"{name}.*",
            failed.alias("base_failed"),
            rate("word_chars", "n_words").alias("word_length"),
            rate("n_symbols", "n_words").alias("symbols"),
            rate("n_dup_lines", "n_lines").alias("dup_lines"),
            rate("n_repeat_words", "n_words").alias("repeats"),
        ),
    )


def sketches(measures: DataFrame, name: str, lang: str, source: str) -> DataFrame:
    """Counts per (lang, source, rate, bucket) over the documents that pass the fixed rules."""
    rates = F.array(*[F.struct(F.lit(r).alias("rate"), bucket(F.col(f"{name}.{r}")).alias("bucket")) for r in RATES])
    return (
        measures.filter(~F.col(f"{name}.base_failed"))
        .select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.explode(rates).alias("r"))
        .groupBy("lang", "source", "r.rate", "r.bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Quartiles of each sketch: bounded windows, as a sketch has some hundred buckets."""
    whole = W.partitionBy(*keys, "rate")
    merged = sketch.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))
    placed = merged.select(
        "*", F.sum("n").over(whole.orderBy("bucket")).alias("upto"), F.sum("n").over(whole).alias("docs")
    )
    quartile = lambda q: F.min(F.when(4 * F.col("upto") >= q * F.col("docs"), F.col("bucket"))).alias(f"q{q}")
    return placed.groupBy(*keys, "rate").agg(F.first("docs").alias("docs"), quartile(1), quartile(3))


def thresholds(sketch: DataFrame, min_docs: int = MIN_DOCS, fence: int = FENCE) -> DataFrame:
    """One row per (lang, source): an array `limits` of (low, high) in the order of RATES."""
    own = _quartiles(sketch, ["lang", "source"])
    by_lang = _quartiles(sketch, ["lang"]).select("lang", "rate", F.struct("docs", "q1", "q3").alias("l"))
    overall = _quartiles(sketch, []).select("rate", F.struct("docs", "q1", "q3").alias("a"))
    joined = own.alias("o").join(by_lang.alias("l"), F.expr("o.lang <=> l.lang AND o.rate = l.rate"), "left")
    joined = joined.join(F.broadcast(overall.alias("a")), F.expr("o.rate = a.rate"), "left")
    pick = lambda q: F.expr(
        f"CASE WHEN o.docs >= {min_docs} THEN o.{q} WHEN l.l.docs >= {min_docs} THEN l.l.{q} ELSE a.a.{q} END"
    )
    low = high = F.lit(None).cast("long")
    for rate, (least, lower, upper) in RATES.items():
        spread = F.greatest(pick("q3") - pick("q1"), F.lit(least).cast("long"))
        here = F.col("o.rate") == rate
        low = F.when(here & F.lit(lower), pick("q1") - fence * spread).otherwise(low)
        high = F.when(here & F.lit(upper), pick("q3") + fence * spread).otherwise(high)
    limits = joined.select("o.lang", "o.source", "o.rate", F.struct(low.alias("low"), high.alias("high")).alias("limit"))
    chosen = [F.first(F.when(F.col("rate") == r, F.col("limit")), ignorenulls=True).alias(r) for r in RATES]
    return limits.groupBy("lang", "source").agg(*chosen)


def judge(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    min_docs: int = MIN_DOCS,
    fence: int = FENCE,
) -> DataFrame:
    """The columns of the table and a struct of counts, rates, `base_failed` and `kept`.

    The struct's name is `quality`, with underscores added where the table has such a column.

    The thresholds are joined by language, source and a salt, so that a source
    with a third of all rows is dealt over 16 keys; nothing has to be broadcast.

    Null text has no words and fails the fixed rules; null languages and sources
    are groups of their own; repeated rows are judged alike; texts of any length
    are measured whole; an empty table stays empty.
    """
    name = unused("quality", docs.columns)
    salt = unused("salt", docs.columns)
    limit = unused("limit", docs.columns)
    measures = measured(docs, text, name)
    rules = thresholds(sketches(measures, name, lang, source), min_docs, fence).select(
        F.col("lang").alias("_lang"),
        F.col("source").alias("_source"),
        F.struct(*RATES).alias(limit),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"),
    )
    salted = measures.withColumn(salt, F.pmod(F.hash(F.xxhash64(text), F.col(f"{name}.n_words")), F.lit(SALTS)))
    joined = salted.join(
        rules,
        salted[lang].eqNullSafe(rules["_lang"]) & salted[source].eqNullSafe(rules["_source"]) & (salted[salt] == rules["_salt"]),
        "left",
    )
    within = F.lit(True)
    for rate in RATES:
        value, bounds = F.col(f"{name}.{rate}"), F.col(f"{limit}.{rate}")
        within &= F.coalesce(value >= bounds["low"], F.lit(True)) & F.coalesce(value <= bounds["high"], F.lit(True))
    verdict = F.col(name).withField("kept", ~F.col(f"{name}.base_failed") & within)
    return joined.select(*[salted[c] for c in docs.columns], verdict.alias(name))


def quality_documents(docs: DataFrame) -> DataFrame:
    """The contract's columns of every document."""
    judged = judge(docs.select("doc_id", "text", "lang", "source"))
    fields = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    return judged.select("doc_id", *[f"quality.{f}" for f in fields])


def quality_stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """The documents that the rules keep."""
    judged = judge(docs)
    return judged.filter(F.col(f"{judged.columns[-1]}.kept")).select(*docs.columns)


def _oracle() -> str:
    def width(v: str) -> str:
        return f"(1::BIGINT << greatest(length(bin({v})) - 6, 0))"

    def quartiles(keys: str) -> str:
        by = f"{keys}, " if keys else ""
        over = f"PARTITION BY {by}rate"
        return f"""SELECT {by}rate, any_value(docs) AS docs,
               min(CASE WHEN 4 * upto >= docs THEN bucket END) AS q1,
               min(CASE WHEN 4 * upto >= 3 * docs THEN bucket END) AS q3
        FROM (SELECT {by}rate, bucket, sum(n) OVER ({over} ORDER BY bucket) AS upto, sum(n) OVER ({over}) AS docs
              FROM (SELECT {by}rate, bucket, count(*) AS n FROM buckets GROUP BY {by}rate, bucket))
        GROUP BY {by}rate"""

    def pick(q: str) -> str:
        return f"CASE WHEN o.docs >= {MIN_DOCS} THEN o.{q} WHEN l.docs >= {MIN_DOCS} THEN l.{q} ELSE a.{q} END"

    least = " ".join(f"WHEN '{r}' THEN {v[0]}" for r, v in RATES.items())
    return f"""
    WITH words AS (
        SELECT doc_id, lang, source, text,
               list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws,
               list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
        FROM documents),
    starts AS (
        SELECT doc_id, i, ws[i : i + {REPEAT_WINDOW - 1}] AS win
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {REPEAT_WINDOW - 2})) AS i FROM words)),
    again AS (
        SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM starts) WHERE n > 1),
    repeats AS (
        SELECT doc_id, count(*) AS n FROM (
            SELECT DISTINCT doc_id, i + j AS place FROM again, range(0, {REPEAT_WINDOW}) t(j)) GROUP BY doc_id),
    counts AS (
        SELECT w.doc_id, lang, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
               length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols,
               len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
        FROM words w LEFT JOIN repeats r USING (doc_id)),
    rates AS (
        SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
               unnest([
                   {{'rate': 'word_length', 'value': CASE WHEN n_words > 0 THEN 1000 * word_chars // n_words ELSE 0 END}},
                   {{'rate': 'symbols', 'value': CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words ELSE 0 END}},
                   {{'rate': 'dup_lines', 'value': CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END}},
                   {{'rate': 'repeats', 'value': CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END}}
               ], recursive := true)
        FROM counts),
    buckets AS (
        SELECT lang, source, rate, value - value % {width('value')} AS bucket FROM rates WHERE NOT base_failed),
    own AS ({quartiles('lang, source')}),
    langs AS ({quartiles('lang')}),
    overall AS ({quartiles('')}),
    limits AS (
        SELECT o.lang, o.source, o.rate, {pick('q1')} AS q1, {pick('q3')} AS q3,
               greatest({pick('q3')} - {pick('q1')}, CASE o.rate {least} END) AS spread
        FROM own o LEFT JOIN langs l ON o.lang IS NOT DISTINCT FROM l.lang AND o.rate = l.rate
        LEFT JOIN overall a ON o.rate = a.rate)
    SELECT doc_id, any_value(n_words) AS n_words, any_value(word_chars) AS word_chars, any_value(n_symbols) AS n_symbols,
           any_value(n_dup_lines) AS n_dup_lines, any_value(n_repeat_words) AS n_repeat_words,
           any_value(base_failed) AS base_failed,
           NOT any_value(base_failed) AND bool_and(
               coalesce(value <= q3 + {FENCE} * spread, true)
               AND (r.rate <> 'word_length' OR coalesce(value >= q1 - {FENCE} * spread, true))) AS kept
    FROM rates r LEFT JOIN limits t
        ON r.lang IS NOT DISTINCT FROM t.lang AND r.source IS NOT DISTINCT FROM t.source AND r.rate = t.rate
    GROUP BY doc_id"""


ORACLE = _oracle()
