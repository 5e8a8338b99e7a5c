"""Exact interpolated quantiles, and modes, without sorting or collecting a column.

A sample brackets each wanted rank between two values.  Values outside the
brackets are then only counted, per zone between brackets; values inside are
grouped, and there are few of them.  On very large tables the brackets first
shrink.  All counts cover the whole table, so the ranks are exact and show
whether a sample missed: it decides about speed, never about the result.
Where samples do not help, counts alone halve the range of values, so that no
column is ever ranked as a whole.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulens.functions.columns import chunks, col, field_type, is_integral
from tabulens.functions.scalars import nan_to_null
from tabulens.operators.frequency import UNTRACKED_SHARE, estimated_top, likely_top

QUARTILES = (0.25, 0.5, 0.75)

#: Accuracy of ``percentile_approx``; ranks are off by at most rows / ACCURACY.
ACCURACY = 10_000
#: Least and most rows from which brackets are drawn.
MIN_SAMPLE, MAX_SAMPLE = 50_000, 10_000_000
#: Up to this many rows a column is its own bracket.
SMALL = 20_000
#: Rows strictly inside a bracket that may be grouped by value.
INSIDE_LIMIT = 1_000_000
#: Misses after which samples are given up for counts.
MAX_MISSES = 6
#: Parts of a range of values that are counted at a time; at most 16 scans narrow all doubles to one.
_PIECES = 16
#: Values among which a sketched mode is chosen.
LIKELY = 20
_COLUMNS_PER_PASS = 32


def _sample(rows: int) -> int:
    """Rows to draw: more from large tables, where narrow brackets save scans."""
    return max(MIN_SAMPLE, min(rows // 5_000, MAX_SAMPLE))


def _margin(rows: int, misses: int = 0) -> float:
    """Half width of a bracket as a share of its rows: six standard errors of a sampled rank,
    twice as many after each miss."""
    return (3 / math.sqrt(_sample(rows)) + 2 / ACCURACY) * 2**misses


@dataclass
class Bracket:
    """The wanted rank of column ``source`` lies among the values in ``[low, high]``."""

    source: int
    probability: int
    rank: float
    rows: int
    low: float
    high: float
    below: int = 0
    settled: bool = False
    stuck: bool = False
    misses: int = 0
    total: int = field(init=False)

    def __post_init__(self) -> None:
        self.total = self.rows

    @property
    def floor(self) -> int:
        return math.floor(self.rank)

    @property
    def ceil(self) -> int:
        return math.ceil(self.rank)

    def miss(self) -> None:
        """Start again from the whole column, with more room."""
        self.misses += 1
        self.low, self.high, self.below, self.rows = -math.inf, math.inf, 0, self.total
        self.settled, self.stuck = False, self.misses >= MAX_MISSES


def first_brackets(
    source: int, rows: int, low: float, high: float, probabilities: Sequence[float]
) -> list[Bracket]:
    """The whole of a column, once per probability; nothing for a column without values."""
    if rows == 0:
        return []
    return [
        Bracket(source, j, p * (rows - 1), rows, low, high, settled=rows <= SMALL)
        for j, p in enumerate(probabilities)
    ]


def settle(df: DataFrame, columns: Sequence[str], brackets: Iterable[Bracket]) -> None:
    """Shrink the brackets of columns that are not small."""
    values = _numbers(df, columns)
    while wide := [b for b in brackets if not b.settled and not b.stuck]:
        expected = {id(b): b.rows * 2 * _margin(b.rows, b.misses) for b in wide}
        _tighten(values, wide)
        large = [b for b in wide if expected[id(b)] > INSIDE_LIMIT]
        for b in wide:
            b.settled = b not in large
        if large:
            _count_inside(values, large)
    if stuck := [b for b in brackets if b.stuck and not b.settled]:
        _bisect(values, stuck)


def _numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(
        *[
            nan_to_null(col(c), field_type(df, c)).cast("double").alias(f"v{i}")
            for i, c in enumerate(columns)
        ]
    )


def _tighten(values: DataFrame, brackets: list[Bracket]) -> None:
    """Move to the edges found in a sample of each bracket's rows."""
    shared: dict[tuple, list[Bracket]] = {}
    for b in brackets:
        shared.setdefault((b.source, b.low, b.high, b.below, b.rows, b.misses), []).append(b)
    edges = []
    for (source, low, high, below, rows, misses), together in shared.items():
        v = F.col(f"v{source}")
        taken = F.when(v.between(low, high) & (F.col("draw") < _sample(rows) / rows), v)
        places = [(b.rank - below) / (rows - 1) for b in together]
        margin = _margin(rows, misses)
        wanted = [min(max(p + m, 0.0), 1.0) for p in places for m in (-margin, margin)]
        edges.append(F.percentile_approx(taken, wanted, ACCURACY))
    most = max(_sample(b.rows) / b.rows for b in brackets)
    seed = 1 + max(b.misses for b in brackets)
    drawn = values.withColumn("draw", F.rand(seed)).where(F.col("draw") < most)
    row = drawn.agg(*[e.alias(f"edges{i}") for i, e in enumerate(edges)]).first()
    for found, ((*_, below, rows, misses), together) in zip(row, shared.items()):
        margin = _margin(rows, misses)
        for j, b in enumerate(together if found else []):
            place = (b.rank - below) / (rows - 1)
            b.low = found[2 * j] if place > margin else b.low
            b.high = found[2 * j + 1] if place + margin < 1 else b.high


def _count_inside(values: DataFrame, brackets: list[Bracket]) -> None:
    """Accept brackets with few rows strictly inside; leave those that do not shrink to counts."""
    counts = []
    for k, b in enumerate(brackets):
        v = F.col(f"v{b.source}")
        counts += [
            F.count_if(v < b.low).alias(f"below{k}"),
            F.count_if((v > b.low) & (v < b.high)).alias(f"strictly{k}"),
            F.count_if(v <= b.high).alias(f"upto{k}"),
        ]
    row = values.agg(*counts).first()
    for k, b in enumerate(brackets):
        below, strictly, upto = row[f"below{k}"], row[f"strictly{k}"], row[f"upto{k}"]
        if not below <= b.floor <= b.ceil < upto:
            b.miss()
            continue
        b.settled = strictly <= INSIDE_LIMIT
        b.stuck = not b.settled and upto - below >= b.rows
        b.below, b.rows = below, upto - below


def _place(number: float) -> int:
    """Rank of a double among all doubles, zero at 0."""
    bits = struct.unpack("<q", struct.pack("<d", number + 0.0))[0]
    return bits if bits >= 0 else -(bits & (2**63 - 1))


def _double(place: int) -> float:
    """The double of a rank."""
    size = struct.unpack("<d", struct.pack("<q", abs(place)))[0]
    return -size if place < 0 else size


def _bisect(values: DataFrame, brackets: list[Bracket]) -> None:
    """Narrow the range around each lower rank by counting until it holds few rows or one value.

    Where the upper rank lies beyond that range, it is the next larger value.
    """
    ranges = [(b, _place(b.low), _place(b.high)) for b in brackets]
    while ranges:
        edges, counts = [], []
        for k, (b, start, end) in enumerate(ranges):
            places = [start - 1 + (end - start + 1) * i // _PIECES for i in range(_PIECES + 1)]
            v = F.col(f"v{b.source}")
            for i, place in enumerate(places):
                none = place < _place(-math.inf)
                counts += [
                    (F.lit(0) if none else F.count_if(v <= _double(place))).alias(f"upto{k}_{i}"),
                    F.min(v if none else F.when(v > _double(place), v)).alias(f"next{k}_{i}"),
                ]
            edges.append(places)
        row = values.agg(*counts).first()
        left = []
        for k, ((b, *_), places) in enumerate(zip(ranges, edges)):
            i = next(i for i in range(1, _PIECES + 1) if row[f"upto{k}_{i}"] > b.floor)
            below, upto = row[f"upto{k}_{i - 1}"], row[f"upto{k}_{i}"]
            start, end = places[i - 1] + 1, places[i]
            if upto - below > INSIDE_LIMIT and start < end:
                left.append((b, start, end))
                continue
            b.low, b.high = _double(start), _double(end)
            if b.ceil >= upto:
                b.high, upto = row[f"next{k}_{i}"], upto + 1
            b.below, b.rows, b.settled = below, upto - below, True
        ranges = left


def _intervals(brackets: Iterable[Bracket]) -> list[tuple[float, float]]:
    """Brackets of one column as disjoint intervals in order."""
    merged: list[tuple[float, float]] = []
    for low, high in sorted((b.low, b.high) for b in brackets):
        if merged and low <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], high))
        else:
            merged.append((low, high))
    return merged


def _zone(value: Column, intervals: list[tuple[float, float]]) -> Column:
    """Odd inside an interval, even between them, rising with the value."""
    passed = [c.cast("int") for low, high in intervals for c in (value >= low, value > high)]
    return reduce(Column.__add__, passed)


def _long_form(df: DataFrame, columns: Sequence[str], sources: Sequence[int], kind: str) -> DataFrame:
    """``source, value`` without missing values."""
    wide = df.select(
        *[
            nan_to_null(col(columns[i]), field_type(df, columns[i])).cast(kind).alias(str(i))
            for i in sources
        ]
    )
    long = wide.unpivot([], [col(str(i)) for i in sources], "source", "value")
    return long.where(F.col("value").isNotNull()).withColumn("source", F.col("source").cast("int"))


def pick(
    df: DataFrame, columns: Sequence[str], brackets: list[Bracket], modes: bool = False
) -> tuple[dict[tuple[int, int], float], dict[int, float]]:
    """Values by (column index, probability index), and modes by column index.

    With ``modes`` the values are counted per distinct value first, which
    takes one shuffle on column and value; without, only bracketed values are.
    """
    used = sorted({b.source for b in brackets})
    parts = []
    for kind in ("bigint", "double"):
        sources = [i for i in used if is_integral(field_type(df, columns[i])) == (kind == "bigint")]
        for group in chunks(sources, _COLUMNS_PER_PASS):
            long = _long_form(df, columns, group, kind)
            parts.append(_zone_counts(long, brackets, group, modes))
    if not parts:
        return {}, {}
    spark = df.sparkSession
    params = spark.createDataFrame(
        [(b.source, b.probability, b.floor, b.ceil) for b in brackets],
        "source int, j int, floor bigint, ceil bigint",
    )
    in_order = W.partitionBy("source").orderBy("zone", "key")
    ranked = reduce(DataFrame.unionAll, parts).withColumn(
        "upto", F.sum("n").over(in_order.rowsBetween(W.unboundedPreceding, 0))
    )
    # One parameter row per column and probability, so its size is that of the schema.
    rows = (
        ranked.join(F.broadcast(params), "source")
        .groupBy("source", "j")
        .agg(
            F.min_by("key", F.when(F.col("upto") > F.col("floor"), F.col("upto"))).alias("lower"),
            F.min_by("key", F.when(F.col("upto") > F.col("ceil"), F.col("upto"))).alias("upper"),
            F.min_by("mode", F.struct(-F.col("mode_n"), "mode")).alias("mode"),
        )
        .collect()
    )
    found, missed = {}, []
    by_key = {(b.source, b.probability): b for b in brackets}
    for row in rows:
        b = by_key[row["source"], row["j"]]
        if row["lower"] is None or row["upper"] is None:
            b.miss()
            missed.append(b)
        else:
            found[b.source, b.probability] = row["lower"] + (row["upper"] - row["lower"]) * (
                b.rank - b.floor
            )
    if missed:
        settle(df, columns, missed)
        found |= pick(df, columns, missed)[0]
    return found, {r["source"]: r["mode"] for r in rows} if modes else {}


def likely_modes(df: DataFrame, columns: Sequence[str]) -> dict[int, float]:
    """Modes by column index: the most frequent of the values that a sketch takes for frequent.

    One scan sketches, another counts those values exactly.
    """
    return {i: mode for i, (mode, _, _) in _counted_candidates(df, columns).items()}


def certain_modes(df: DataFrame, columns: Sequence[str], rows: Sequence[int]) -> dict[int, float]:
    """Those of ``likely_modes`` that are certainly the modes, of columns with so many values.

    A value that the sketch dropped has at most ``UNTRACKED_SHARE`` of the rows, and
    one that it kept, but did not list, has no more than the least listed estimate.
    A counted value above both bounds is the mode.
    """
    counted = _counted_candidates(df, columns)
    return {i: mode for i, (mode, n, bound) in counted.items() if n > max(bound, rows[i] * UNTRACKED_SHARE)}


def _counted_candidates(df: DataFrame, columns: Sequence[str]) -> dict[int, tuple[float, int, int]]:
    """By column index the most frequent of a sketch's listed values, its exact count, and the most that any other value has."""
    modes: dict[int, tuple[float, int, int]] = {}
    for kind in ("bigint", "double"):
        sources = [i for i, c in enumerate(columns) if is_integral(field_type(df, c)) == (kind == "bigint")]
        for group in chunks(sources, _COLUMNS_PER_PASS):
            values = {i: nan_to_null(col(columns[i]), field_type(df, columns[i])).cast(kind) for i in group}
            sketched = df.agg(*[estimated_top(v, LIKELY).alias(str(i)) for i, v in values.items()]).first()
            likely = {i: [v["item"] for v in sketched[str(i)] if v["item"] is not None] for i in group}
            bounds = {i: sketched[str(i)][-1]["count"] if len(sketched[str(i)]) >= LIKELY else 0 for i in group}
            chosen = [F.when(F.col("source") == i, F.col("value").isin(*found)) for i, found in likely.items()]
            counts = (
                _long_form(df, columns, group, kind)
                .where(F.coalesce(*chosen))
                .groupBy("source", "value")
                .agg(F.count(F.lit(1)).alias("n"))
            )
            best = F.min(F.struct((-F.col("n")).alias("less"), "value")).alias("best")
            for row in counts.groupBy("source").agg(best).collect():
                found = row["best"]
                modes[row["source"]] = float(found["value"]), -found["less"], bounds[row["source"]]
    return modes


def _zone_counts(
    long: DataFrame, brackets: list[Bracket], sources: Sequence[int], modes: bool
) -> DataFrame:
    """``source, zone, key, n, mode_n, mode``: one row per zone outside the brackets,
    one per value inside."""
    if modes:
        long = long.groupBy("source", "value").agg(F.count(F.lit(1)).alias("n"))
    number = F.col("value").cast("double")
    zones = [
        F.when(F.col("source") == i, _zone(number, _intervals(b for b in brackets if b.source == i)))
        for i in sources
    ]
    zoned = long.withColumn("zone", F.coalesce(*zones)).withColumn(
        "key", F.when(F.col("zone") % 2 == 1, number)
    )
    groups = zoned.groupBy("source", "zone", "key")
    if not modes:
        none = F.lit(None)
        return groups.agg(F.count(F.lit(1)).alias("n")).select(
            "*", none.cast("bigint").alias("mode_n"), none.cast("double").alias("mode")
        )
    return groups.agg(
        F.sum("n").alias("n"),
        F.max("n").alias("mode_n"),
        F.min_by("value", F.struct(-F.col("n"), "value")).cast("double").alias("mode"),
    )


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float] = QUARTILES
) -> DataFrame:
    """``column, q0, q1, ...``: linear interpolation between neighbouring ranks.

    ``columns`` must be numeric; quantiles of a column without values are NULL.
    """
    values = [F.col(f"v{i}") for i in range(len(columns))]
    aggregates = [f(v) for v in values for f in (F.count, F.min, F.max)]
    row = _numbers(df, columns).agg(*[a.alias(f"a{i}") for i, a in enumerate(aggregates)]).first()
    brackets = [
        b
        for i in range(len(columns))
        for b in first_brackets(i, *row[3 * i : 3 * i + 3], probabilities)
    ]
    settle(df, columns, brackets)
    found, _ = pick(df, columns, brackets)
    rows = [
        (name, *[found.get((i, j)) for j in range(len(probabilities))])
        for i, name in enumerate(columns)
    ]
    schema = "column string, " + ", ".join(f"q{j} double" for j in range(len(probabilities)))
    return df.sparkSession.createDataFrame(rows, schema)
