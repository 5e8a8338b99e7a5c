"""Near duplicates: banded MinHash candidates, odd sketches, then the full sets.

1. Texts become sets of hashed shingles. Equal sets (by `key`, a 128-bit hash)
   are one node from here on, so a group of exact copies counts as a single text.
   A node is a long: keys would be most of what the bands and pairs move.
2. MinHash values in 44 bands of 8 make candidates; two sets with similarity
   0.85 share no band with a probability of 8e-7.
3. The same MinHash samples, folded into a parity bitmap of 512 bits (an odd
   sketch), tell from the number of differing bits which candidates are far
   apart. The bound leaves out less than one link in 10 million.
4. What remains is compared on the full sets. Only such links count.

Pairs are not listed within a bucket. First each node is compared with the least
node of each of its buckets, and links make components. Then only nodes of one
bucket in different components matter, and of those only pairs that can be
links: a pair either shares a shingle that few sets have, and is found through
that shingle, or its common part lies within what is frequent in both, which
bounds its similarity by counts. Copies of one text with many edits each fail
both, so the outliers of a large group are not compared with all of it.

Texts are needed again for the full sets of few nodes. A small Bloom filter of
their ids keeps the other texts out of the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.functions.storage import stage
from tabulens.llm.components import least_nodes
from tabulens.llm.exact import maybe_among
from tabulens.llm.shared import bounded_batches, give_back, inside, mixed, rolling, slices, split_words, word_hashes

BANDS = 44
ROWS = 8
SKETCH_LONGS = 8
SLACK = 0.2
#: A shingle in no more sets than this leads to all of them.
RARE = 20
#: Nodes of a bucket that share a salt, and the most salts of one.
SALTED, SALTS = 1000, 64


def shingle_sets(texts: pa.Array, length: int) -> list[np.ndarray]:
    """Sorted 64-bit hashes of the different shingles of each text, A-Z lower-cased.

    A text of fewer words is one shingle; a text without words has none.
    """
    offsets, words = split_words(texts)
    hashes = word_hashes(words, lower=True)[:, 0]
    rolled, valid = rolling(hashes, length), inside(offsets, length)
    sets = []
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if end - start >= length:
            here = rolled[start : end - length + 1][valid[start : end - length + 1]]
            sets.append(np.unique(here))
        elif end > start:
            sets.append(rolling(hashes[start:end], end - start))
        else:
            sets.append(hashes[:0])
    return sets


def min_hashes(sets: list[np.ndarray], count: int) -> np.ndarray:
    """`count` MinHash values of each non-empty set, one row per set."""
    lengths = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    starts = np.cumsum(lengths) - lengths
    items = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    seeds = np.random.default_rng(1).integers(1, 2**63, size=(count, 2), dtype=np.uint64)
    least = np.empty((len(sets), count), dtype=np.uint64)
    for i, (add, times) in enumerate(seeds):
        least[:, i] = np.minimum.reduceat((items ^ add) * (times | np.uint64(1)), starts)
    return least


def band_keys(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(least), bands), dtype=np.uint64)
    keys += np.arange(1, bands + 1, dtype=np.uint64)
    for i in range(rows):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + least[:, i : bands * rows : rows])
    return keys


def odd_sketch(least: np.ndarray, longs: int) -> np.ndarray:
    """The parity of the samples that fall on each of 64 * `longs` bits."""
    count = least.shape[1]
    place = mixed(least ^ mixed(np.arange(1, count + 1, dtype=np.uint64))) % np.uint64(64 * longs)
    parity = np.zeros((len(least), 64 * longs), dtype=np.uint8)
    rows = np.arange(len(least))
    for i in range(count):
        parity[rows, place[:, i]] ^= 1
    return np.packbits(parity, axis=1, bitorder="little").view("<i8")


def most_different_bits(similarity: float, samples: int, longs: int) -> int:
    """Expected differing bits of two odd sketches of sets with this similarity."""
    bits = 64 * longs
    return int(np.ceil(bits / 2 * (1 - np.exp(-4 * samples * (1 - similarity) / bits))))


def signatures(docs: DataFrame, length: int) -> DataFrame:
    """All columns but the text, n_shingles, key (a 128-bit hash of the set), bands and sketch; both empty without shingles."""
    others = [c for c in docs.columns if c != "text"]
    names = [*others, "n_shingles", "key", "bands", "sketch"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), length)
                sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
                least = min_hashes([s for s in sets if len(s)], BANDS * ROWS)
                keys = band_keys(least, BANDS, ROWS).view(np.int64)
                sketch = odd_sketch(least, SKETCH_LONGS)
                some = np.concatenate(([0], np.cumsum(sizes > 0)))
                lists = lambda values: pa.ListArray.from_arrays(
                    pa.array(some * values.shape[1], pa.int32()), pa.array(values.reshape(-1), pa.int64())
                )
                digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                made = [pa.array(sizes), pa.array(digests, pa.binary()), lists(keys), lists(sketch)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), *made], names)
        give_back()

    kept = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in others)
    return docs.mapInArrow(sign, f"{kept}n_shingles long, key binary, bands array<long>, sketch array<long>")


def full_sets(docs: DataFrame, length: int) -> DataFrame:
    """(key, items) of the texts of rows (doc_id, text)."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), length)
                ends = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), lists], ["key", "items"])
        give_back()

    return docs.select("text").mapInArrow(collect, "key binary, items array<long>")


def _close(threshold: int) -> Column:
    """Whether two sketched sets may reach the similarity: by their sizes and differing bits."""
    limit = most_different_bits(threshold / 100 - SLACK, BANDS * ROWS, SKETCH_LONGS)
    differing = sum((F.bit_count(F.expr(f"a.sketch[{i}] ^ b.sketch[{i}]")) for i in range(SKETCH_LONGS)), F.lit(0))
    least, most = F.least("a.n_shingles", "b.n_shingles"), F.greatest("a.n_shingles", "b.n_shingles")
    return (100 * least >= threshold * most) & (differing <= limit)


def close_pairs(pairs: DataFrame, nodes: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that the sketches leave, with the keys of both (key_a, key_b)."""
    sketched = nodes.select("node", "key", "n_shingles", "sketch")
    joined = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).join(sketched.alias("a"), F.expr("x = a.node"))
    joined = joined.join(sketched.alias("b"), F.expr("y = b.node")).filter(_close(threshold))
    return joined.select(F.col("x").alias("a"), F.col("y").alias("b"), F.col("a.key").alias("key_a"), F.col("b.key").alias("key_b"))


def sets_of(wanted: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """The full sets (key, items) of the nodes that the ids (doc_id) belong to, from their texts read again.

    Which node a text is follows from the text, so shared ids only add sets that
    nothing asks for. Texts of other ids do not take part in the join.
    """
    ids = stage(wanted.select(F.col("doc_id").alias("wanted")).distinct(), "wanted")
    flagged = maybe_among(docs, "doc_id", ids, "wanted")
    texts = flagged.filter(flagged.columns[-1]).select(*docs.columns)
    texts = texts.join(ids, texts["doc_id"].eqNullSafe(ids["wanted"]), "left_semi")
    return stage(full_sets(texts, length), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) of rows (a, b, key_a, key_b) whose full sets reach the similarity."""
    both = pairs.join(sets.select(F.col("key").alias("key_a"), F.col("items").alias("x")), "key_a").drop("key_a")
    both = both.join(sets.select(F.col("key").alias("key_b"), F.col("items").alias("y")), "key_b")
    shared = F.size(F.array_intersect("x", "y"))
    counts = both.select("a", "b", (F.size("x") + F.size("y")).alias("total"), shared.alias("shared"))
    enough = 100 * F.col("shared") >= threshold * (F.col("total") - F.col("shared"))
    return counts.filter(enough).select("a", "b").distinct()


def pairs_across(placed: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs of nodes in different components that may be links.

    `placed` has the nodes with their root and those of their bands that hold several roots. Let `frequent` be the shingles
    of a node that more than `RARE` sets have. Nodes that share none of the others
    have at most min(frequent) in common.

    It is written in parts: as one plan, the driver would have to follow some
    thirty shuffles at a time.
    """
    items = sets.join(placed.select("key", "node", "root"), "key").select("node", "root", F.explode("items").alias("item"))
    counts = items.groupBy("item").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1")
    counted = stage(items.join(counts, "item"), "counted")
    frequent = counted.filter(F.col("sets") > RARE).groupBy("node").agg(F.count(F.lit(1)).alias("frequent"))

    # At most RARE nodes per shingle are brought together.
    few = counted.filter(F.col("sets") <= RARE)
    lists = few.groupBy("item").agg(F.collect_set(F.struct("node", "root")).alias("l"))
    found = F.expr(
        "flatten(transform(l, x -> transform(filter(l, y -> x.root < y.root), y -> struct(x.node AS a, y.node AS b))))"
    )
    by_rare = lists.select(F.explode(found).alias("p")).select("p.*")

    sizes = placed.select("n_shingles", F.explode("bands").alias("band"))
    smallest = sizes.groupBy("band").agg(F.min("n_shingles").alias("smallest"))
    # A node whose frequent part is too small even for the smallest set of its bucket is out.
    most = f"frequent * {100 + threshold} >= {threshold} * (n_shingles + smallest)"
    known = placed.select("node", "root", "n_shingles", "sketch", "bands").join(frequent, "node")
    known = known.withColumn("band", F.explode("bands"))
    left = stage(known.join(smallest, "band").filter(most).drop("smallest"), "left")
    common = "least(a.frequent, b.frequent)"
    bound = f"100 * {common} >= {threshold} * (a.n_shingles + b.n_shingles - {common})"
    # A pair that shares several buckets counts in the least of them.
    first = "array_min(array_intersect(a.bands, b.bands)) = a.band"
    by_frequent = across_roots(left, F.expr(bound) & _close(threshold) & F.expr(first))
    return by_rare.unionByName(by_frequent).distinct()


def across_roots(members: DataFrame, may_link: Column) -> DataFrame:
    """The pairs (a, b) of nodes of one band and different roots that meet a condition on `a` and `b`.

    Of each band only nodes outside of its largest root are joined with all its
    nodes, so pairs of that root are never formed. Large bands are dealt over
    salts; `members` has band, node, root and what the condition needs.
    """
    roots = members.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"))
    bands = roots.groupBy("band").agg(
        F.max(F.struct("n", "root"))["root"].alias("largest"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("roots")
    )
    salts = F.least(F.lit(SALTS), F.ceil(F.col("size") / SALTED)).cast("int").alias("salts")
    known = members.join(bands.filter("roots > 1").select("band", "largest", salts), "band")
    few = known.filter("root <> largest").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    whole = known.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    # Two nodes outside of the largest root meet in both orders: one counts.
    apart = F.expr("a.band = b.band AND a.salt = b.salt AND (b.root = b.largest OR a.root < b.root)")
    pairs = few.alias("a").join(whole.alias("b"), apart & may_link)
    in_order = F.expr("a.root < b.root")
    return pairs.select(
        F.when(in_order, F.col("a.node")).otherwise(F.col("b.node")).alias("a"),
        F.when(in_order, F.col("b.node")).otherwise(F.col("a.node")).alias("b"),
    )


def near_rows(docs: DataFrame, length: int, threshold: int) -> DataFrame:
    """The columns but the text, n_shingles, component_id, first and copies per row of (doc_id, text, others).

    `first` tells whether the row is the least of its component, by id (rows
    without one last) and then by the other columns. `copies` counts the rows
    with the same set.
    """
    others = [c for c in docs.columns if c != "text"]
    signed = stage(signatures(docs, length), "signatures")
    # One row per different set; copies combine in each task before the shuffle.
    firsts = [F.first(c).alias(c) for c in ("n_shingles", "sketch", "bands")]
    some = signed.filter("n_shingles > 0")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), *others)
    sets = some.groupBy("key").agg(F.min(rank).alias("least"), F.count(F.lit(1)).alias("copies"), *firsts)
    sets = sets.withColumns({"doc_id": F.col("least.doc_id"), "node": F.monotonically_increasing_id()})
    nodes = stage(sets, "nodes")
    # Moved once: the pivots and the join need no other shuffle.
    bands = nodes.select("node", F.explode("bands").alias("band")).repartition("band")
    pivots = bands.groupBy("band").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = stage(bands.join(pivots.drop("n"), "band"), "members")

    # By the node, so that neither making them distinct nor the join moves them again.
    star = members.filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).repartition("a").distinct()
    near = stage(close_pairs(star, nodes, threshold), "pairs")
    wanted = near.select(F.col("a").alias("node")).union(near.select("b")).distinct()
    sets = sets_of(nodes.join(wanted, "node", "left_semi"), docs, length)
    links = stage(confirmed(near, sets, threshold), "links")
    roots = least_nodes(links)

    placed = members.join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    several = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
    apart = stage(placed.join(several, "band", "left_semi"), "apart")
    own = apart.groupBy("node").agg(F.min("root").alias("root"), F.collect_set("band").alias("bands"))
    placed = stage(nodes.select("node", "key", "doc_id", "n_shingles", "sketch").join(own, "node"), "placed")
    sets = sets_of(placed, docs, length)
    across = stage(pairs_across(placed, sets, threshold), "across")
    across = stage(close_pairs(across, placed, threshold), "pairs")
    more = stage(confirmed(across, sets, threshold), "links")
    if not more.isEmpty():
        # The stars found so far stand for their links.
        roots = least_nodes(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    rooted = nodes.select("node", "key", "least", "copies").join(roots, "node", "left")
    rooted = rooted.select("key", F.coalesce("root", "node").alias("root"), "least", "copies")
    least = rooted.groupBy("root").agg(F.min("least").alias("least"))
    found = rooted.drop("least").join(least, "root").select("key", "least", "copies")
    linked = some.select(*others, "n_shingles", "key").join(found, "key")
    first = rank.eqNullSafe(F.col("least")).alias("first")
    linked = linked.select(*others, "n_shingles", F.col("least.doc_id").alias("component_id"), first, "copies")
    alone = signed.filter("n_shingles = 0")
    alone = alone.select(*others, "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True), F.lit(1))
    return linked.union(alone)


def near_groups(
    docs: DataFrame, text: str = "text", id_column: str = "doc_id", length: int = 5, threshold: int = 80
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable) and kept per row.

    `threshold` is the similarity in per cent. Rows without a word are linked
    with nothing and kept, null text as well. A row without an id stays only in
    a component without ids, and it has no component_id there. Rows that share
    an id are judged by their own texts. Texts of any length are compared by all
    their shingles. An empty table gives no rows.
    """
    docs = bounded_batches(docs).select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    rows = near_rows(docs, length, threshold).select("doc_id", "n_shingles", "component_id")
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_documents(docs: DataFrame) -> DataFrame:
    """The contract's rows: three-word shingles, similarity of 0.85 or more."""
    return near_groups(docs, length=3, threshold=85)


def near_stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies stays (five words, 0.8).

    Rows are told apart by id and text, so a row without an id, or one that
    shares its id with another text, goes or stays by its own judgement.
    """
    digest = F.unhex(F.sha2(F.encode("text", "utf-8"), 256))
    rows = near_rows(bounded_batches(docs).select("doc_id", "text", digest.alias("digest")), 5, 80)
    judged = stage(rows.filter("NOT first OR copies > 1").select("doc_id", "digest", "first"), "judged")
    named = judged.select(F.col("doc_id").alias("gone"), "digest", "first")

    def same(found: DataFrame):
        return docs["doc_id"].eqNullSafe(found["gone"]) & (digest == found["digest"])

    # Texts of ids that no judged row has stay where they are.
    flagged = maybe_among(docs, "doc_id", named, "gone")
    maybe, own = F.col(flagged.columns[-1]), docs.columns
    passed, docs = flagged.filter(~maybe).select(*own), flagged.filter(maybe).select(*own)
    gone = named.filter("NOT first").drop("first").distinct()
    left = docs.join(gone, same(gone), "left_anti")
    # Equal rows are judged alike: of those that stay, one does.
    twice = named.filter("first").groupBy("gone", "digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    if twice.isEmpty():
        return passed.unionByName(left)
    once = docs.join(twice, same(twice), "left_semi").dropDuplicates(["doc_id", "text"])
    return passed.unionByName(left.join(twice, same(twice), "left_anti")).unionByName(once)


ORACLE = r"""
    WITH RECURSIVE words AS (
        SELECT doc_id, list_filter(string_split_regex(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
        FROM documents),
    shingles AS (
        SELECT DISTINCT doc_id, ws[i : i + 2] AS s
        FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM words WHERE len(ws) > 0)),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    shared AS (
        SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i
        FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (
        SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
        WHERE 100 * i >= 85 * (p.n + q.n - i)),
    reach AS (
        SELECT doc_id, doc_id AS other FROM documents
        UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.other)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
    FROM (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) LEFT JOIN sizes USING (doc_id)"""
