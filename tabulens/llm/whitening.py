"""Whitening of embeddings from exact integer covariances.

Entries become integers, floor(64 * entry) + 1000000. Every task cuts each
dimension, shifted by its least value in the batch, into bit planes and packs a
plane over the rows into 64-bit words. The population count of the AND of two
planes says in how many rows both bits are set; weighted with the planes' powers
of two these counts are exact sums of products. They are carried as limbs of 31
bits, so that Spark's sums of longs stay exact at every size. The driver gets one
number per pair of dimensions, centres them as integers (n * sum(xy) - sum(x) *
sum(y)), and only the finished covariance becomes floating point for `eigh`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens.llm.shared import bounded_batches, give_back

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
#: Rows whose planes are packed together.
BATCH_ROWS = 16_384
LIMB = 31
#: Entries beyond this have no long integer.
LARGEST = 2.0**62 / SCALE
_SAFE = 1 << 62


@dataclass(frozen=True)
class Whitener:
    """Sums and components; `sums` and `n` are exact, with entries less `OFFSET`."""

    n: int
    sums: tuple[int, ...]
    directions: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers with an integer."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) >= LARGEST))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def fit_list(rows: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """The rows with a usable vector of the commonest length (of equals, the longest), and that length."""
    good = rows.filter(usable(F.col(vector)))
    size = F.size(F.col(vector))
    sizes = good.select(size.alias("size")).filter("size > 0").groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    top = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    if top is None:
        return good.limit(0), 0
    return good.filter(size == top["size"]), top["size"]


def integers(vectors: pa.Array, size: int) -> np.ndarray:
    """A row of integers per vector, less `OFFSET`."""
    values = pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(values * SCALE).astype(np.int64).reshape(-1, size)


def bit_planes(shifted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The planes of columns of unsigned integers: their columns, bits, and words over all rows.

    Planes are ordered by column; a column has as many as its largest value has bits.
    """
    rows = len(shifted)
    words = -(-rows // 64)
    columns, bits, packed = [], [], []
    for bit in range(int(shifted.max(initial=0)).bit_length()):
        set_ = ((shifted >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8)
        alive = np.nonzero((shifted >> np.uint64(bit)).any(axis=0))[0]
        plane = np.zeros((len(alive), words * 8), dtype=np.uint8)
        plane[:, : -(-rows // 8)] = np.packbits(set_[:, alive], axis=0).T
        columns.append(alive)
        bits.append(np.full(len(alive), bit))
        packed.append(plane.view(np.uint64))
    if not packed:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, words), np.uint64)
    order = np.argsort(np.concatenate(columns), kind="stable")
    return np.concatenate(columns)[order], np.concatenate(bits)[order], np.concatenate(packed)[order]


def plane_products(shifted: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Exact column sums, and sums of products of columns i <= j, of columns of unsigned integers.

    `kind` is np.int64, or object where sums may not fit.
    """
    size = shifted.shape[1]
    columns, bits, planes = bit_planes(shifted)
    sums, products = np.zeros(size, dtype=kind), np.zeros((size, size), dtype=kind)
    weights = np.array([1 << int(b) for b in bits], dtype=kind)
    counts = np.bitwise_count(planes).sum(axis=1, dtype=np.int64).astype(kind)
    np.add.at(sums, columns, counts * weights)
    first = np.searchsorted(columns, np.arange(size))
    for number, column in enumerate(columns):
        start = first[column]
        both = np.bitwise_count(planes[number] & planes[start:]).sum(axis=1, dtype=np.int64).astype(kind)
        np.add.at(products[column], columns[start:], both * weights[start:] * weights[number])
    return sums, products


def scatter(values: np.ndarray) -> np.ndarray:
    """Exact upper triangle of the sums of products of the columns, a column of ones before them."""
    rows, size = values.shape
    low = values.min(axis=0)
    spread = max(int(h) - int(m) for h, m in zip(values.max(axis=0), low))
    reach = max(spread, max(abs(int(v)) for v in (*low, *values.max(axis=0))), 1)
    kind = np.int64 if rows * reach * reach * 4 < _SAFE else object
    sums, products = plane_products((values.view(np.uint64) - low.view(np.uint64)), kind)
    low = low.astype(kind) if kind is np.int64 else np.array([int(v) for v in low], dtype=object)
    made = np.zeros((size + 1, size + 1), dtype=kind)
    made[0, 0] = rows
    made[0, 1:] = sums + rows * low
    made[1:, 1:] = products + np.outer(sums, low) + np.outer(low, sums) + rows * np.outer(low, low)
    return np.triu(made)


def to_limbs(values: np.ndarray) -> np.ndarray:
    """The numbers as limbs of 31 bits, lowest first, the last one with the sign: numbers x limbs."""
    limbs = []
    while True:
        if len(limbs) and not np.any(values != 0):
            return np.stack(limbs, axis=1).astype(np.int64)
        if not np.any(values >= (1 << LIMB)) and not np.any(values < 0):
            limbs.append(values)
            return np.stack(limbs, axis=1).astype(np.int64)
        if not np.any(values < -(1 << LIMB)) and not np.any(values >= (1 << LIMB)):
            limbs.append(values)
            return np.stack(limbs, axis=1).astype(np.int64)
        limbs.append(values & ((1 << LIMB) - 1))
        values = values >> LIMB


def batches_of(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most so many rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def products(vectors: DataFrame, size: int) -> DataFrame:
    """Exact sums of products as (i, j, limb, value); i = 0 is a column of ones. `vectors` has one column."""
    upper = np.triu_indices(size + 1)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: list[np.ndarray] = []
        for batch in batches_of(batches, BATCH_ROWS):
            limbs = to_limbs(scatter(integers(batch.column(0), size))[upper])
            for number in range(limbs.shape[1]):
                if number == len(totals):
                    totals.append(np.zeros(len(limbs), dtype=np.int64))
                totals[number] += limbs[:, number]
        for number, total in enumerate(totals):
            some = np.nonzero(total)[0]
            columns = upper[0][some], upper[1][some], np.full(len(some), number), total[some]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["i", "j", "limb", "value"])
        give_back()

    made = bounded_batches(vectors).mapInArrow(local, "i long, j long, limb long, value long")
    return made.groupBy("i", "j", "limb").agg(F.sum("value").alias("value"))


def fit(good: DataFrame, size: int, vector: str = "embedding", components: int = COMPONENTS) -> Whitener:
    """The whitening of the rows of `fit_list`.

    Directions without variance (an eigenvalue that double precision cannot tell
    from zero) have no whitened values and are left out.
    """
    total = [[0] * (size + 1) for _ in range(size + 1)]
    # One row per pair of dimensions and limb.
    for row in products(good.select(vector), size).collect():
        total[row["i"]][row["j"]] += row["value"] << (LIMB * row["limb"])
    n, sums = total[0][0], tuple(total[0][1:])
    covariance = np.zeros((size, size))
    for i in range(size):
        for j in range(i, size):
            centred = n * total[i + 1][j + 1] - sums[i] * sums[j]
            covariance[i, j] = covariance[j, i] = centred / (n * n)
    values, directions = np.linalg.eigh(covariance)
    values, directions = values[::-1], directions[:, ::-1]
    count = int(np.sum(values[:components] > max(values[0], 0.0) * size * np.finfo(float).eps))
    if values[0] <= 0:
        count = 0
    explained = values[:count] / np.trace(covariance) if count else np.zeros(0)
    return Whitener(n, sums, np.ascontiguousarray(directions[:, :count]), values[:count].copy(), explained)


def project(values: np.ndarray, model: Whitener) -> np.ndarray:
    """Whitened components of rows of integers."""
    means = np.array([s / model.n for s in model.sums])
    return (values - means) @ (model.directions / np.sqrt(model.eigenvalues))


def deviations(values: np.ndarray, model: Whitener) -> list[int | None]:
    """Sum of (n * x - sum of x)^2 over the dimensions; None where it is no long."""
    reach = model.n * max(1, int(np.abs(values).max(initial=0))) + max(map(abs, model.sums), default=0)
    if reach * reach * max(1, values.shape[1]) < _SAFE:
        apart = values * model.n - np.array(model.sums, dtype=np.int64)
        return (apart * apart).sum(axis=1).tolist()
    found = (sum((model.n * x - s) ** 2 for x, s in zip(row, model.sums)) for row in values.tolist())
    return [f if f < 1 << 63 else None for f in found]


def identity_error(good: DataFrame, size: int, model: Whitener, vector: str = "embedding") -> float:
    """Largest absolute entry of the whitened rows' own covariance less the identity."""
    count = len(model.eigenvalues)
    upper = np.triu_indices(count + 1)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((count + 1, count + 1))
        for batch in batches_of(batches, BATCH_ROWS):
            made = project(integers(batch.column(0), size), model)
            made = np.concatenate([np.ones((len(made), 1)), made], axis=1)
            total += made.T @ made
        columns = [pa.array(upper[0], pa.int64()), pa.array(upper[1], pa.int64()), pa.array(total[upper])]
        yield pa.RecordBatch.from_arrays(columns, ["i", "j", "value"])
        give_back()

    sums = bounded_batches(good.select(vector)).mapInArrow(local, "i long, j long, value double")
    total = np.zeros((count + 1, count + 1))
    for row in sums.groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        total[row["i"], row["j"]] = total[row["j"], row["i"]] = row["value"]
    mean = total[0, 1:] / model.n
    return float(np.abs(total[1:, 1:] / model.n - np.outer(mean, mean) - np.eye(count)).max())


def whiten(
    rows: DataFrame, vector: str = "embedding", id_column: str = "vec_id", components: int = COMPONENTS
) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of each usable row and component.

    Vectors that are null, empty, hold null or non-finite entries (or entries
    whose integer is no long), or have another length than most, are dropped and
    not fitted. An empty table, a single row or equal rows have no variance and
    give no rows, as do directions without variance. A deviation that is no long
    is null. Null ids and repeated rows are rows like others; other columns do
    not matter. The driver holds a number per pair of dimensions, never rows.
    """
    narrow = rows.select(F.col(id_column).alias("vec_id"), F.col(vector).alias("embedding"))
    narrow = narrow.withColumn("embedding", F.col("embedding").cast("array<double>"))
    schema = T.StructType(
        [
            narrow.schema["vec_id"],
            *T.StructType.fromDDL(
                "component int, n long, deviation long, whitened double, explained double, identity_error double"
            ).fields,
        ]
    )
    good, size = fit_list(narrow)
    if not size:
        return rows.sparkSession.createDataFrame([], schema)
    model = fit(good, size, components=components)
    count = len(model.eigenvalues)
    if not count:
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(good, size, model)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, BATCH_ROWS):
            values = integers(batch.column(1), size)
            times = np.repeat(np.arange(len(values)), count)
            deviation = pa.array(deviations(values, model), pa.int64())
            columns = [
                batch.column(0).take(pa.array(times)),
                pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(values))),
                pa.array(np.full(len(times), model.n, dtype=np.int64)),
                deviation.take(pa.array(times)),
                pa.array(project(values, model).reshape(-1)),
                pa.array(np.tile(model.explained, len(values))),
                pa.array(np.full(len(times), error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema.names)
        give_back()

    return bounded_batches(good).mapInArrow(made, schema)


def whitened_embeddings(rows: DataFrame) -> DataFrame:
    return whiten(rows)
