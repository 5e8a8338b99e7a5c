"""Chart aggregates: group, order, limit.

Charts of one table that aggregate by key share a ``Batch``: grouping sets of all
their keys in one scan with one partial aggregation, and the first points of
every chart by one ranking, of which each task keeps only as many.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulens.functions.columns import col, data_columns, field_type, is_large, is_summable
from tabulens.functions.scalars import (
    as_number,
    average,
    is_missing,
    label_text,
    nan_to_null,
    safe_corr,
    total,
)

# How much of a chart is shown.
LINE_POINTS = 50
BAR_GROUPS = 15
PIE_SLICES = 10
SCATTER_POINTS = 200
BINS = 10
MIN_HISTOGRAM_VALUES = 5

#: Share of the rows of a large table that a bound for its first keys is taken from.
SAMPLED = 0.001

#: A document lists the points of a chart up to so many; only a pie with a value column has more.
LISTED_POINTS = 10_000

AGGREGATIONS = ("sum", "mean", "count", "none")


class Skipped(Exception):
    """The request does not fit the table; the text says why."""


@dataclass
class Chart:
    """Labels of a chart and its data, still lazy: ``label, y`` or, for scatters, ``x, y``.

    ``shared`` is the batch that has the points, too, and the chart's number in it.
    """

    chart_id: str
    type: str
    title: str
    x_label: str | None
    y_label: str | None
    data: DataFrame
    told: str | Callable[[], str] = ""
    shared: tuple[Batch, int] | None = None

    @cached_property
    def description(self) -> str:
        """The description; one that needs the points is computed when it is first read."""
        return self.told() if callable(self.told) else self.told

    def payload(self) -> dict[str, Any]:
        """Collect the points with display rounding.

        Those of a chart with more than ``LISTED_POINTS`` stay where they are:
        the payload names the table of points instead.
        """
        rows = self.shared[0].rows(self.shared[1]) if self.shared else self.data.limit(LISTED_POINTS + 1).collect()
        if len(rows) > LISTED_POINTS:
            points: dict[str, Any] = {"table": "charts", "chart_id": self.chart_id}
        elif self.type == "scatter":
            points = {
                "datasets": [
                    {
                        "label": f"{self.x_label} vs {self.y_label}",
                        "data": [{"x": r["x"], "y": r["y"]} for r in rows],
                    }
                ]
            }
        else:
            values = [None if r["y"] is None else round(r["y"], 2) for r in rows]
            points = {
                "labels": [r["label"] for r in rows],
                "datasets": [{"label": self.y_label, "data": values}],
            }
        return {
            "type": self.type,
            "title": self.title,
            "x_label": self.x_label,
            "y_label": self.y_label,
            "description": self.description,
            "data": points,
        }


def filled(df: DataFrame, *names: str) -> DataFrame:
    """Rows that have a value in every named column; NULL tests reach the scan."""
    return df.where(reduce(and_, [~is_missing(col(n), field_type(df, n)) for n in names]))


def number(df: DataFrame, name: str) -> Column:
    return as_number(col(name), field_type(df, name))


def _keyed(df: DataFrame, x: str, *others: Column) -> DataFrame:
    """Rows with a key, narrowed to the columns a chart needs."""
    return filled(df, x).select(col(x).alias("key"), *others)


def _aggregate(value: Column, dtype: T.DataType, how: str) -> Column:
    if how == "count":
        return F.count(value).cast("double")
    if how == "mean":
        return average(value, dtype)
    return F.coalesce(total(value, dtype), F.lit(0.0))


def first_keys(df: DataFrame, x: str, keys: int) -> Column:
    """A condition that holds for the first ``keys`` values of ``x``, and in a large table for few others.

    Of a sample's values as many first ones are all among the table's, so the last
    of them is a bound that the table's first ones do not exceed. With fewer in the
    sample there is no bound.  Only the sample's values are shuffled to find it;
    the scan then leaves out all rows beyond.
    """
    if not is_large(df):
        return F.lit(True)
    found = _keyed(df.sample(SAMPLED, 1), x).distinct().orderBy("key").limit(keys)
    bound = found.agg(F.when(F.count(F.lit(1)) == keys, F.max("key")).alias("bound"))
    return F.coalesce(col(x) <= bound.scalar(), F.lit(True))


def group_values(df: DataFrame, x: str, y: str, how: str = "sum") -> DataFrame:
    """``key, y``: count, mean or (for anything else) sum of ``y`` per value of ``x``.

    Rows without a key do not count; an all-missing group sums to 0, has no
    mean, and counts 0.
    """
    rows = _keyed(df, x, nan_to_null(col(y), field_type(df, y)).alias("value"))
    return rows.groupBy("key").agg(_aggregate(F.col("value"), field_type(df, y), how).alias("y"))


def labelled(df: DataFrame, x: str, grouped: DataFrame) -> DataFrame:
    return grouped.select(label_text(F.col("key"), field_type(df, x)).alias("label"), "y")


def line_chart(df: DataFrame, x: str, y: str) -> DataFrame:
    """Mean of ``y`` for the first keys in key order."""
    return xy_chart(df, x, y, "mean")


def bar_chart(df: DataFrame, x: str, y: str) -> DataFrame:
    """Groups with the highest mean of ``y``."""
    best = group_values(df, x, y, "mean").orderBy(F.desc_nulls_last("y"), "key").limit(BAR_GROUPS)
    return labelled(df, x, best)


def xy_chart(df: DataFrame, x: str, y: str, how: str = "sum") -> DataFrame:
    """Aggregate of ``y`` for the first keys in key order."""
    if groupable(field_type(df, x)):
        df = df.where(first_keys(df, x, LINE_POINTS))
    return labelled(df, x, group_values(df, x, y, how).orderBy("key").limit(LINE_POINTS))


def pie_chart(df: DataFrame, x: str, y: str | None = None) -> DataFrame:
    """Sum of ``y`` for every key in key order, or the most frequent keys."""
    if y:
        return labelled(df, x, group_values(df, x, y, "sum").orderBy("key"))
    counts = _keyed(df, x).groupBy("key").agg(F.count(F.lit(1)).cast("double").alias("y"))
    return labelled(df, x, counts.orderBy(F.desc("y"), "key").limit(PIE_SLICES))


def histogram(df: DataFrame, column: str) -> DataFrame | None:
    """``bin, low, high, label, y``: ten equal bins, the last one closed.

    None with fewer than five values.  The first scan finds the range; the
    second counts values at or above each inner edge, so the comparison is
    with the edges themselves and no bin is missing.
    """
    values = filled(df, column).select(number(df, column).alias("v"))
    row = values.agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    edges = bin_edges(column, row["n"], row["low"], row["high"])
    return None if edges is None else histogram_of(df, column, edges)


def bin_edges(column: str, values: int, low: float | None, high: float | None) -> list[float] | None:
    """Edges of the bins of so many values in a range; None if there are too few values."""
    if values < MIN_HISTOGRAM_VALUES:
        return None
    if low in (float("inf"), float("-inf")) or high in (float("inf"), float("-inf")):
        raise Skipped(f"{column} has infinite values")
    if low == high:
        low, high = low - 0.5, high + 0.5
    step = (high - low) / BINS
    return [i * step + low for i in range(BINS)] + [high]


def bin_label(edges: Sequence[float], i: int) -> str:
    return f"{edges[i]:.1f}–{edges[i + 1]:.1f}"


def histogram_of(df: DataFrame, column: str, edges: Sequence[float]) -> DataFrame:
    """The bins between known edges."""
    values = filled(df, column).select(number(df, column).alias("v"))
    reached = [F.count_if(F.col("v") >= edges[i]).alias(f"from{i}") for i in range(1, BINS)]
    counts = values.agg(F.count("v").alias("from0"), *reached).withColumn(f"from{BINS}", F.lit(0))
    bins = [
        F.struct(
            F.lit(i).alias("bin"),
            F.lit(edges[i]).alias("low"),
            F.lit(edges[i + 1]).alias("high"),
            F.lit(bin_label(edges, i)).alias("label"),
            (F.col(f"from{i}") - F.col(f"from{i + 1}")).cast("double").alias("y"),
        )
        for i in range(BINS)
    ]
    return counts.select(F.inline(F.array(*bins)))


def scatter_points(df: DataFrame, x: str, y: str, order: Column) -> DataFrame:
    """``x, y`` of the first complete pairs in ingestion order."""
    pairs = filled(df, x, y).select(number(df, x).alias("x"), number(df, y).alias("y"), order.alias("at"))
    return pairs.orderBy("at").limit(SCATTER_POINTS).select("x", "y")


def points_correlation(points: DataFrame) -> DataFrame:
    """Correlation of the plotted points only: 0 for a single one, NULL if a side is constant."""
    corr = F.when(F.count(F.lit(1)) <= 1, F.lit(0.0)).otherwise(safe_corr(F.col("x"), F.col("y")))
    return points.agg(corr.alias("correlation"))


def groupable(dtype: T.DataType) -> bool:
    """Keys that sort; nested ones are left to charts of their own."""
    return not isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType, T.BinaryType))


@dataclass(frozen=True)
class _Shared:
    """What a chart of a batch needs: its key and aggregate, by their numbers, and how much of it is shown.

    ``label`` turns the key into text; ``edges`` are those of a histogram, whose
    keys are the numbers of bins.
    """

    key: int
    aggregate: int
    label: Column
    by_value: bool
    limit: int
    edges: tuple[float, ...] = ()


class Batch:
    """Charts of one table that aggregate by a key: one scan, one shuffle, one ranking for all of them."""

    def __init__(self, df: DataFrame):
        self.df = df
        self.charts: list[_Shared] = []
        self._keys: dict[str, Column] = {}
        self._values: dict[str, Column] = {}
        self._aggregates: dict[tuple[str, str], Column] = {}

    def add(self, x: str, y: str | None, how: str, limit: int, by_value: bool = False) -> int:
        """A chart of the first keys, or of those with the highest values; returns its number."""
        dtype = field_type(self.df, x)
        known = nan_to_null(col(x), dtype)
        if by_value:
            key = self._key(f"key of {x}", known)
        else:
            # Rows beyond the first keys take part without a key, as rows without one do.
            key = self._key(f"first of {x}", F.when(first_keys(self.df, x, limit), known) if is_large(self.df) else known)
        label = label_text(F.col(f"k{key}"), dtype)
        self.charts.append(_Shared(key, self._aggregate(y, how), label, by_value, limit))
        return len(self.charts) - 1

    def add_histogram(self, x: str, edges: Sequence[float]) -> int:
        """A chart of all bins; a value is in the bin of the last edge that it reaches."""
        value = number(self.df, x)
        reached = reduce(lambda a, b: a + b, [(value >= edge).cast("int") for edge in edges[1:BINS]])
        key = self._key(f"bin of {x}", F.when(~is_missing(col(x), field_type(self.df, x)), reached))
        labels = F.array(*[F.lit(bin_label(edges, i)) for i in range(BINS)])
        label = F.element_at(labels, F.col(f"k{key}") + 1)
        self.charts.append(_Shared(key, self._aggregate(None, "count"), label, False, BINS, tuple(edges)))
        return len(self.charts) - 1

    def _key(self, name: str, key: Column) -> int:
        self._keys.setdefault(name, key)
        return list(self._keys).index(name)

    def _aggregate(self, y: str | None, how: str) -> int:
        how = how if how in ("count", "mean") else "sum"
        if (y or "", how) not in self._aggregates:
            value, made = F.lit(1), F.count(F.lit(1)).cast("double")
            if y:
                dtype = field_type(self.df, y)
                if y not in self._values:
                    self._values[y] = nan_to_null(col(y), dtype)
                value = F.col(f"w{list(self._values).index(y)}")
                made = _aggregate(value, dtype, how)
            self._aggregates[y or "", how] = made
        return list(self._aggregates).index((y or "", how))

    @cached_property
    def points(self) -> DataFrame:
        """``chart, place, label, y`` of all charts, few rows; ``place`` counts from 0 in display order."""
        keys = [f"k{i}" for i in range(len(self._keys))]
        wide = self.df.select(
            *[key.alias(k) for k, key in zip(keys, self._keys.values())],
            *[value.alias(f"w{i}") for i, value in enumerate(self._values.values())],
        )
        wide = wide.where(reduce(or_, [F.col(k).isNotNull() for k in keys]))
        sets = wide.groupingSets([[F.col(k)] for k in keys], *keys) if len(keys) > 1 else wide.groupBy(*keys)
        aggregates = [a.alias(f"v{i}") for i, a in enumerate(self._aggregates.values())]
        grouping = [F.grouping_id().alias("g")] if len(keys) > 1 else []
        grouped = sets.agg(*grouping, *aggregates)
        # All bits are set but that of the key which a row is grouped by.
        bits = [(1 << len(keys)) - 1 - (1 << (len(keys) - 1 - i)) for i in range(len(keys))]

        def of(chart: _Shared) -> Column:
            own = F.col(keys[chart.key]).isNotNull()
            return own & (F.col("g") == bits[chart.key]) if len(keys) > 1 else own

        rows = [
            F.when(of(c), F.struct(F.lit(i).alias("chart"), c.label.alias("label"), F.col(f"v{c.aggregate}").alias("y")))
            for i, c in enumerate(self.charts)
        ]
        named = grouped.select(*keys, F.explode(F.array_compact(F.array(*rows))).alias("row")).select(*keys, "row.*")
        best = [i for i, c in enumerate(self.charts) if c.by_value]
        value = F.when(F.col("chart").isin(best), F.col("y")) if best else F.lit(None).cast("double")
        order = W.partitionBy("chart").orderBy(value.desc_nulls_last(), *keys)
        # A literal limit lets every task keep that many rows per chart only.
        ranked = named.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(c.limit for c in self.charts))
        limits = F.array(*[F.lit(c.limit) for c in self.charts])
        shown = ranked.where(F.col("place") <= F.element_at(limits, F.col("chart") + 1))
        bins = [(i, c) for i, c in enumerate(self.charts) if c.edges]
        place = F.col("place") - 1
        for i, c in bins:
            place = F.when(F.col("chart") == i, F.col(keys[c.key])).otherwise(place)
        shown = shown.select("chart", place.cast("int").alias("place"), "label", "y")
        if not bins:
            return shown
        # Bins without a value are rows, too.
        empty = [(i, n, bin_label(c.edges, n), 0.0) for i, c in bins for n in range(BINS)]
        all_bins = self.df.sparkSession.createDataFrame(empty, "chart int, place int, label string, y double")
        return shown.unionByName(all_bins).groupBy("chart", "place", "label").agg(F.max("y").alias("y"))

    @cached_property
    def _collected(self) -> list:
        return sorted(self.points.collect(), key=lambda r: (r["chart"], r["place"]))

    def rows(self, number: int) -> list:
        """The points of one chart; all charts are collected at once, a few dozen points each."""
        return [r for r in self._collected if r["chart"] == number]


def build_chart(
    df: DataFrame, instruction: Mapping[str, Any], order: Column, number: int = 1, batch: Batch | None = None
) -> Chart:
    """Chart for one instruction; raises ``Skipped`` where it does not fit the table.

    Its points are in ``batch``, too, unless it is a scatter or has no limit.
    """
    kind = instruction.get("type", "bar")
    x, y = instruction.get("x"), instruction.get("y") or None
    how = instruction.get("aggregation", "sum")
    names = data_columns(df)
    if x not in names:
        raise Skipped(f"unknown column {x}")
    if y is not None and y not in names:
        raise Skipped(f"unknown column {y}")
    if x == y:
        raise Skipped("both axes show the same column")
    if kind not in ("pie", "line", "bar", "scatter"):
        kind = "bar"
    if y is None and kind != "pie":
        raise Skipped("no column to aggregate")
    counting = kind in ("line", "bar") and how == "count"
    if y is not None and not counting and not is_summable(field_type(df, y)):
        raise Skipped(f"{y} is not numeric")
    shared = None
    together = batch is not None and groupable(field_type(df, x))
    if kind == "scatter":
        if not is_summable(field_type(df, x)):
            raise Skipped(f"{x} is not numeric")
        data = scatter_points(df, x, y, order)
    elif kind == "pie":
        data = pie_chart(df, x, y)
        if together and not y:
            shared = batch, batch.add(x, None, "count", PIE_SLICES, by_value=True)
    else:
        data = xy_chart(df, x, y, how)
        if together:
            shared = batch, batch.add(x, y, how, LINE_POINTS)
    return Chart(
        instruction.get("id", f"chart_{number}"),
        kind,
        instruction.get("title", f"{y} by {x}"),
        x,
        y,
        data,
        instruction.get("description", ""),
        shared,
    )


def build_charts(
    df: DataFrame, instructions: Iterable[Mapping[str, Any]], order: Column
) -> tuple[list[Chart], list[tuple[str, str]]]:
    """Charts that fit, and ``(chart id, reason)`` of those that do not."""
    charts: list[Chart] = []
    skipped: list[tuple[str, str]] = []
    batch = Batch(df)
    for number, instruction in enumerate(instructions, 1):
        try:
            charts.append(build_chart(df, instruction, order, number, batch))
        except Skipped as reason:
            skipped.append((instruction.get("id", f"chart_{number}"), str(reason)))
    return charts, skipped


def charts_frame(charts: list[Chart]) -> DataFrame | None:
    """All points in one table: ``chart_id, position, label, x, y``.

    ``position`` rises in display order; it has gaps in a chart whose keys
    fill several partitions.
    """
    if not charts:
        return None
    batches: dict[int, list[Chart]] = {}
    for chart in charts:
        if chart.shared:
            batches.setdefault(id(chart.shared[0]), []).append(chart)
    together = [members for members in batches.values() if len(members) > 1]
    single = [c for c in charts if not any(c is m for members in together for m in members)]
    tables = [_shared_points(members) for members in together]
    tables += [
        c.data.select(
            F.lit(c.chart_id).alias("chart_id"),
            F.monotonically_increasing_id().alias("position"),
            *(
                (F.lit(None).cast("string").alias("label"), "x")
                if c.type == "scatter"
                else ("label", F.lit(None).cast("double").alias("x"))
            ),
            "y",
        )
        for c in single
    ]
    return reduce(DataFrame.unionAll, tables)


def _shared_points(charts: list[Chart]) -> DataFrame:
    """The points of charts of one batch."""
    ids = F.create_map(*[F.lit(v) for c in charts for v in (c.shared[1], c.chart_id)])
    return (
        charts[0]
        .shared[0]
        .points.where(F.col("chart").isin([c.shared[1] for c in charts]))
        .select(
            F.element_at(ids, F.col("chart")).alias("chart_id"),
            F.col("place").cast("bigint").alias("position"),
            "label",
            F.lit(None).cast("double").alias("x"),
            "y",
        )
    )
