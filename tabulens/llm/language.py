"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's words are lower-cased and stripped to their letters; their runs of 1 to
4 signs, with marks for both word ends, are hashed to buckets. The mean of the
buckets' embeddings goes through a linear layer and a softmax. Stochastic
gradient descent in numpy learns both from a bounded, balanced sample of labelled
texts. Rows that take no part in it set the temperature that makes the
probability honest, and the score below which a prediction counts as rejected.

The linear layer is folded into the embeddings for prediction, so each different
word of a batch is scored once and a text is the sum of its words. A text of any
length is used whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.llm.shared import bounded_batches, give_back, inside, rolling, slices, split_words
from tabulens.llm.tokenizing import gather

BUCKETS = 1 << 14
DIMENSIONS = 16
LENGTHS = (1, 2, 3, 4)
#: The fit's bounds: labelled rows that it learns from, and languages (the most frequent ones).
TRAIN_ROWS = 2000
LANGUAGES = 256
#: Of a sampled text the fit also sees stretches of so many words, as short texts are predicted, too.
STRETCHES = (2, 8)
EPOCHS = 12
BATCH = 32
RATE = 0.5
#: Share of right predictions, among those of about the same score, from which a score is accepted.
ACCEPTED = 0.9
UNKNOWN = "und"
FOLDS = 5
#: Subwords that are scored at a time.
CHUNK = 1 << 20


@dataclass(frozen=True)
class Model:
    """Bucket scores per language (languages x buckets), offsets, temperature and least accepted score."""

    languages: tuple[str, ...]
    scores: np.ndarray
    offsets: np.ndarray
    temperature: float = 1.0
    accepted: float = 0.0


def cleaned(words: pa.LargeStringArray) -> pa.LargeStringArray:
    """Lower-case words without anything but letters and the marks on them; empty where there is no letter."""
    words = pc.replace_substring_regex(pc.utf8_lower(words), r"[^\pL\pM]+", "")
    return pc.if_else(pc.match_substring_regex(words, r"\pL"), words, "")


def subwords(words: pa.LargeStringArray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the words' subwords, and the bucket of each; an empty word has none."""
    signs = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.where(signs > 0, signs + 2, 0)
    offsets = np.concatenate(([0], np.cumsum(size)))
    marked = "".join(f"<{word}>" for word in words.to_pylist() if word)
    codes = np.frombuffer(marked.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    counts = sum(np.maximum(size - length + 1, 0) for length in LENGTHS)
    ends = np.cumsum(counts)
    found = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
    place = ends - counts
    for length in LENGTHS:
        own = inside(offsets, length)
        hashed = rolling(codes, length)[own] >> np.uint64(32)
        each = np.maximum(size - length + 1, 0)
        at = np.arange(len(hashed)) + np.repeat(place - (np.cumsum(each) - each), each)
        found[at] = (hashed % np.uint64(buckets)).astype(np.int64)
        place = place + each
    return np.concatenate(([0], ends)), found


def parts_of(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word offsets of the texts, the number of each word, and subword offsets and buckets of the different words."""
    offsets, words = split_words(texts)
    coded = words.dictionary_encode()
    word_offsets, found = subwords(cleaned(coded.dictionary), buckets)
    return offsets, coded.indices.to_numpy(zero_copy_only=False), word_offsets, found


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each stretch between offsets; of an empty one 0."""
    made = np.zeros(len(offsets) - 1, dtype=values.dtype)
    some = np.diff(offsets) > 0
    if some.any():
        made[some] = np.add.reduceat(values, offsets[:-1][some])
    return made


def logits(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Texts x languages, and the number of subwords of each text."""
    offsets, codes, word_offsets, found = parts_of(texts, model.scores.shape[1])
    counts = sums(np.diff(word_offsets)[codes], offsets)
    made = np.zeros((len(offsets) - 1, len(model.languages)))
    cuts = np.searchsorted(word_offsets, np.arange(0, len(found) + CHUNK, CHUNK))
    cuts = np.unique(np.concatenate((cuts, [0, len(word_offsets) - 1])).clip(0, len(word_offsets) - 1))
    for number, scores in enumerate(model.scores):
        words = np.zeros(len(word_offsets) - 1)
        for low, high in zip(cuts[:-1], cuts[1:]):
            first, last = word_offsets[low], word_offsets[high]
            words[low:high] = sums(scores[found[first:last]], word_offsets[low : high + 1] - first)
        made[:, number] = sums(words[codes], offsets) / np.maximum(counts, 1) + model.offsets[number]
    return made, counts


def softmax(values: np.ndarray) -> np.ndarray:
    raised = np.exp(values - values.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def held_out(id_column: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is divisible by `FOLDS`; a null id is not, but is not learned from either."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def examples(labelled: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(lang, rank, kind, buckets, weights) of texts and of a stretch of them per length of `STRETCHES`.

    `labelled` has lang, rank (from 0 to 1 within its language, in random order)
    and text. An example has at most one number per bucket, however long the text.
    """
    schema = "lang string, rank double, kind int, buckets array<int>, weights array<float>"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                offsets, codes, word_offsets, found = parts_of(part.column("text"), buckets)
                rows = []
                ranks, sizes = part.column("rank").to_pylist(), np.diff(word_offsets)
                for i, (lang, rank) in enumerate(zip(part.column("lang").to_pylist(), ranks)):
                    own = codes[offsets[i] : offsets[i + 1]]
                    for kind, length in enumerate((len(own), *STRETCHES)):
                        start = int(rank * 1e9) % max(1, len(own) - length + 1)
                        taken = own[start : start + length]
                        held = gather(word_offsets[taken], sizes[taken], found)
                        if len(held):
                            different, counts = np.unique(held, return_counts=True)
                            rows.append((lang, rank, kind, different, (counts / len(held)).astype(np.float32)))
                if rows:
                    kinds = pa.string(), pa.float64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float32())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(column, k) for column, k in zip(zip(*rows), kinds)],
                        ["lang", "rank", "kind", "buckets", "weights"],
                    )
        give_back()

    return bounded_batches(labelled).mapInArrow(local, schema)


def sample(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """lang, rank and text of about `rows` labelled texts that are not held out, as many of each language as there are.

    The choice hangs on the ids alone, so a rerun takes the same rows.
    """
    usable = docs.filter(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    narrow = usable.select("lang", F.shiftrightunsigned(F.xxhash64("doc_id"), 11).alias("order"), "text")
    rank = F.col("order") / F.lit(float(1 << 53))
    if not counts:
        return narrow.select("lang", rank.alias("rank"), "text").limit(0)
    each = rows / len(counts)
    shares = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, each / r["n"]))])
    share = F.try_element_at(shares, F.col("lang"))
    return narrow.filter(rank < share).select("lang", (rank / share).alias("rank"), "text")


def descend(
    rows: list[tuple[int, np.ndarray, np.ndarray]], languages: int, buckets: int, epochs: int = EPOCHS
) -> tuple[np.ndarray, np.ndarray]:
    """Folded bucket scores and offsets, by stochastic gradient descent over (language, buckets, weights)."""
    rng = np.random.default_rng(0)
    embeddings = rng.normal(0, 1 / DIMENSIONS, (buckets, DIMENSIONS)).astype(np.float32)
    layer = np.zeros((DIMENSIONS, languages), dtype=np.float32)
    offsets = np.zeros(languages, dtype=np.float32)
    steps, step = max(1, epochs * -(-len(rows) // BATCH)), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for start in range(0, len(rows), BATCH):
            taken = [rows[i] for i in order[start : start + BATCH]]
            active, at = np.unique(np.concatenate([r[1] for r in taken]), return_inverse=True)
            means = np.zeros((len(taken), len(active)), dtype=np.float32)
            means[np.repeat(np.arange(len(taken)), [len(r[1]) for r in taken]), at] = np.concatenate([r[2] for r in taken])
            hidden = means @ embeddings[active]
            error = softmax(hidden @ layer + offsets)
            error[np.arange(len(taken)), [r[0] for r in taken]] -= 1
            rate = RATE * (1 - step / steps)
            # An embedding's share of a mean is small, so its steps are longer, by the size of the mean.
            down = means / np.maximum((means * means).sum(axis=1, keepdims=True), 1e-6)
            embeddings[active] -= rate / len(taken) * (down.T @ (error @ layer.T))
            layer -= rate * (hidden.T @ error)
            offsets -= rate / len(taken) * error.sum(axis=0)
            step += 1
    return (embeddings @ layer).T.astype(np.float64), offsets.astype(np.float64)


def calibrated(values: np.ndarray, right: np.ndarray) -> tuple[float, float]:
    """Temperature of the least log loss, and the least score whose predictions are right often enough.

    How often is an isotonic regression of right or wrong on the score, so a
    steady share of wrong labels does not reject everything.
    """
    if not len(right):
        return 1.0, 0.0
    choices = np.geomspace(0.05, 20, 121)
    losses = [-np.log(softmax(values / t)[np.arange(len(right)), right] + 1e-12).mean() for t in choices]
    temperature = float(choices[int(np.argmin(losses))])
    scores = softmax(values / temperature)
    best, hit = scores.max(axis=1), scores.argmax(axis=1) == right
    order = np.argsort(best, kind="stable")
    pools: list[list[float]] = []
    for score, good in zip(best[order].tolist(), hit[order].tolist()):
        pools.append([score, float(good), 1.0])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, rights, count = pools.pop()
            pools[-1][1] += rights
            pools[-1][2] += count
    enough = [least for least, rights, count in pools if rights >= ACCEPTED * count]
    return temperature, enough[0] if enough else float("inf")


def fit(docs: DataFrame, rows: int = TRAIN_ROWS, buckets: int = BUCKETS) -> Model | None:
    """The model of the languages in `lang`; None without a labelled text that has a letter.

    At most `rows` texts are learned from, each with at most one number per
    bucket, whatever the size of the table; a fifth of them only calibrates.
    """
    bound = rows * (1 + len(STRETCHES))
    found = examples(sample(docs, rows), buckets).orderBy("rank", "lang", "kind", "weights").limit(bound).toArrow()
    if not found.num_rows:
        return None
    languages = tuple(sorted(set(found.column("lang").to_pylist())))
    number = {lang: i for i, lang in enumerate(languages)}
    chunks = found.combine_chunks()
    lists = [chunks.column(c).combine_chunks() for c in ("buckets", "weights")]
    offsets = lists[0].offsets.to_numpy()
    held, weights = (a.values.to_numpy(zero_copy_only=False) for a in lists)
    made = [
        (number[lang], held[s:e], weights[s:e])
        for lang, s, e in zip(found.column("lang").to_pylist(), offsets[:-1], offsets[1:])
    ]
    aside = [int(r * 1e7) % 5 == 0 for r in found.column("rank").to_pylist()]
    train = [m for m, a in zip(made, aside) if not a] or made
    scores, base = descend(train, len(languages), buckets)
    tests = [m for m, a in zip(made, aside) if a]
    values = np.array([scores[:, b] @ w for _, b, w in tests]).reshape(-1, len(languages)) + base
    return Model(languages, scores, base, *calibrated(values, np.array([t[0] for t in tests], dtype=np.int64)))


def identify(docs: DataFrame, model: Model | None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and rejected of every row.

    `lang_pred` is the likeliest of the model's languages. A null text, one
    without a letter, and every text without a model is `und` with score 0 and
    rejected. `rejected` also marks predictions whose calibrated score is too low
    to rely on. Repeated rows, null ids and extra columns do not matter; an empty
    table gives no rows.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                predicted = np.full(part.num_rows, UNKNOWN, dtype=object)
                scores = np.zeros(part.num_rows)
                if model is not None:
                    values, counts = logits(part.column("text"), model)
                    shares = softmax(values / model.temperature)
                    some = counts > 0
                    predicted[some] = np.array(model.languages, dtype=object)[shares.argmax(axis=1)][some]
                    scores[some] = shares.max(axis=1)[some]
                rejected = (predicted == UNKNOWN) | (scores < (model.accepted if model else 0.0))
                columns = [part.column("doc_id"), pa.array(predicted, pa.string()), pa.array(scores), pa.array(rejected.astype(bool))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "rejected"])
        give_back()

    return bounded_batches(rows).mapInArrow(local, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def language_documents(docs: DataFrame) -> DataFrame:
    """The languages of all documents by a model of those that are not held out."""
    rows = docs.select("doc_id", "lang", "text")
    found = identify(rows, fit(rows))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
