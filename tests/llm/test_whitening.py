"""Whitening against exact integers and numpy."""

import math
import os
import random

import numpy as np
import pyarrow as pa
import pytest

from tabulens.llm import whitening
from tabulens.llm.queries import QUERIES
from tabulens.llm.shared import table

FOLDER = os.environ.get("TABLES", "/root/testdata/sf0.001")


def checked(rows, vectors, components=32):
    """`vectors`: the usable ones with their ids."""
    size = len(vectors[0][1])
    xs = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in vectors]
    n = len(xs)
    sums = [sum(column) for column in zip(*xs)]
    covariance = np.array(
        [[(n * sum(x[i] * x[j] for x in xs) - sums[i] * sums[j]) / n**2 for j in range(size)] for i in range(size)]
    )
    values = np.linalg.eigvalsh(covariance)[::-1]
    count = min(components, size)
    assert len(rows) == n * count
    by_id = {}
    for r in rows:
        by_id.setdefault(r["vec_id"], {})[r["component"]] = r
    assert sorted(by_id) == sorted(i for i, _ in vectors)
    made = np.array([[by_id[i][k + 1]["whitened"] for k in range(count)] for i, _ in vectors])
    assert np.abs(made.T @ made / n - np.eye(count)).max() < 1e-4
    # Cross-covariance with x gives the directions, whatever their signs.
    centred = np.array(xs) - np.array(sums) / n
    directions = centred.T @ made / n / np.sqrt(values[:count])
    assert np.allclose(covariance @ directions, directions * values[:count], atol=1e-6 * values[0])
    assert np.allclose(np.linalg.norm(directions, axis=0), 1)
    for (i, _), x in zip(vectors, xs):
        for k, r in by_id[i].items():
            assert r["n"] == n
            assert r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x, sums))
            assert r["explained"] == pytest.approx(values[k - 1] / np.trace(covariance), rel=1e-4)
            assert r["identity_error"] < 1e-4
    assert len({r["identity_error"] for r in rows}) == 1


def test_query_over_the_whole_table(spark):
    vectors = [(r["vec_id"], r["embedding"]) for r in table(spark, FOLDER, "embeddings").collect()]
    good = [(i, v) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    checked(QUERIES["op13_whitening"](spark, FOLDER).collect(), good)


def test_edges(spark):
    rng = random.Random(5)
    good = [(i, [rng.gauss(0, 1) * (j + 1) for j in range(5)]) for i in range(60)]
    bad = [
        (100, None), (101, []), (102, [1.0, None, 0.0, 0.0, 0.0]), (103, [float("nan")] * 5),
        (104, [float("inf")] + [0.0] * 4), (105, [1.0, 2.0]), (106, [1e300] * 5),
    ]
    clashes = "component n deviation whitened explained identity_error size i j limb value".split()
    schema = "vec_id long, embedding array<double>, " + ", ".join(f"{c} string" for c in clashes)
    frame = spark.createDataFrame([(*r, *["x"] * len(clashes)) for r in good + bad], schema).repartition(4)
    checked(whitening.whiten(frame).collect(), good)
    assert whitening.whiten(frame, components=2).count() == 120
    assert whitening.whiten(frame.limit(0)).collect() == []
    assert whitening.whiten(frame.filter("vec_id >= 100 AND vec_id < 105")).collect() == []
    assert whitening.whiten(frame.filter("vec_id = 3")).collect() == []


def test_null_ids_repeated_rows_and_constant_dimensions(spark):
    rng = random.Random(6)
    rows = [(i if i % 3 else None, [float(rng.randint(-9, 9)), 2.5, float(rng.randint(0, 3))]) for i in range(30)] * 2
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(found) == 2 * 60  # the constant dimension has no variance
    assert {r["n"] for r in found} == {60}
    assert sum(r["vec_id"] is None for r in found) == 2 * 20


def test_large_entries_stay_exact(spark):
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-1, 1) * 2.0**40, rng.uniform(-1, 1)]) for i in range(40)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    xs = [[math.floor(64 * c) for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*xs)]
    for r in found:
        exact = sum((40 * x - s) ** 2 for x, s in zip(xs[r["vec_id"]], sums))
        assert r["deviation"] == (exact if exact < 1 << 63 else None)


@pytest.mark.parametrize("spread", [1, 3, 200, 2**40, 2**61])
def test_bit_planes_give_exact_products(spread):
    rng = random.Random(spread)
    values = [[rng.randint(-spread, spread) for _ in range(4)] for _ in range(131)]
    made = whitening.scatter(np.array(values, dtype=np.int64))
    limbs = whitening.to_limbs(made.reshape(-1))
    ones = [[1, *v] for v in values]
    for i in range(5):
        for j in range(i, 5):
            exact = sum(v[i] * v[j] for v in ones)
            assert made[i, j] == exact
            assert sum(int(x) << (31 * k) for k, x in enumerate(limbs[i * 5 + j])) == exact


def test_entries_are_floored():
    vectors = pa.array([[0.1, -0.1], [1.0, -1.0]], pa.list_(pa.float64()))
    assert whitening.integers(vectors, 2).tolist() == [[6, -7], [64, -64]]
