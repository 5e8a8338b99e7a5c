"""Automatic report and instruction-driven analysis of one table."""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulens.functions.columns import (
    POSITION,
    aggregated,
    col,
    data_fields,
    is_numeric,
    is_temporal,
    is_text,
)
from tabulens.operators import charts as C
from tabulens.operators.choose import best_categorical, best_numeric
from tabulens.operators.frequency import distinct_sketches, distinct_values, narrow_columns
from tabulens.operators.insights import (
    ENOUGH_INSIGHTS,
    TOP_SHOWN,
    Insight,
    insights_frame,
    plan_analyses,
    top_up,
)
from tabulens.operators.profile import (
    add_quantiles,
    add_values,
    dataset_summary,
    date_aggregates,
    describe_dataset,
    profile_frame,
    scan_columns,
)
from tabulens.operators.state import State
from tabulens.operators.types import (
    MAX_CATEGORIES,
    ColumnType,
    by_kind,
    candidate_layouts,
    classify,
    fitting_layouts,
    layout_masks,
    shapes_of,
    types_frame,
)
from tabulens.plans.suggest import suggest_instructions


@dataclass
class Described:
    """Types and profile of a table, one dictionary per column.

    ``basics`` lacks quartiles and modes of numbers, and the values of other
    columns (but has the number of values where there are few); ``rows`` has them,
    too, and computes them when it is first read.
    """

    spark: SparkSession
    types: list[ColumnType]
    basics: list[dict[str, Any]]
    row_count: int
    complete: Callable[[], None] | None = None
    state: State = field(default_factory=dict)

    @property
    def rows(self) -> list[dict[str, Any]]:
        if self.complete:
            self.complete()
            self.complete = None
        return self.basics

    @property
    def kinds(self) -> dict[str, list[str]]:
        return by_kind(self.types)

    @property
    def basic_profile(self) -> DataFrame:
        """The profile without quartiles, modes and values."""
        return profile_frame(self.spark, self.basics)

    @property
    def profile(self) -> DataFrame:
        return profile_frame(self.spark, self.rows)

    def stats(self, column: str) -> dict[str, Any]:
        """Statistics of one column with display rounding."""
        row = next(r for r in self.rows if r["column"] == column)
        return {k: round(v, 4) if isinstance(v, float) else v for k, v in row.items()}

    def summary(self) -> DataFrame:
        return dataset_summary(self.types, self.basic_profile, self.row_count)

    def metadata(self) -> dict[str, Any]:
        """Plain dictionary of sizes, types, column groups and statistics."""
        hidden = ("position", "column")
        return {
            "row_count": self.row_count,
            "column_count": len(self.types),
            "columns": [t.column for t in self.types],
            "column_types": {
                t.column: {
                    "dtype": t.dtype,
                    "semantic_type": t.semantic_type,
                    "is_numeric": t.is_numeric,
                    "is_date": t.is_date,
                    "is_categorical": t.is_categorical,
                }
                for t in self.types
            },
            **{f"{k}_columns": v for k, v in self.kinds.items()},
            "statistics": {
                r["column"]: {
                    k: v
                    for k, v in self.stats(r["column"]).items()
                    if v is not None and k not in hidden
                }
                for r in self.rows
            },
            "missing_values": sum(r["null_count"] for r in self.basics),
        }


def describe(
    df: DataFrame,
    infer_strings: bool = True,
    had_gaps: Collection[str] = (),
    approx: bool = False,
) -> Described:
    """Detect types and compute the profile in few scans.

    One aggregate covers counts, moments and date ranges of every column, shapes of
    texts and sketches of their values; another the layouts of string dates with
    their ranges, and the values of columns with few.  Only when the rest is read
    are the texts' values counted, and the numbers scanned again, for a sample and
    then with a shuffle of distinct values.
    """
    fields = data_fields(df)
    names = [f.name for f in fields]
    texts = [f.name for f in fields if is_text(f.dataType)] if infer_strings else []
    numeric = [f.name for f in fields if is_numeric(f.dataType)]
    others = [f.name for f in fields if not (is_numeric(f.dataType) or is_temporal(f.dataType))]
    sketches = {("values", n): v for n, v in distinct_sketches(df, others).items()}
    scanned = scan_columns(df, names, {}, approx, shapes_of(texts) | sketches)
    first = scanned.pop(None, {})
    present = {n: (s["count"], s["count"] + s["null_count"]) for n, s in scanned.items()}
    row_count = max((rows for _, rows in present.values()), default=0)

    candidates = candidate_layouts(first, texts)
    narrow = narrow_columns({n: first["values", n] for n in others if ("values", n) in first}, MAX_CATEGORIES)
    second = aggregated(
        df,
        layout_masks(candidates)
        | date_aggregates(df, candidates)
        | {("distinct", n): distinct_values(df, n) for n in narrow},
    )
    fitting = fitting_layouts(second, candidates)
    columns = {}
    for f in fields:
        column = {"dtype": f.dataType.simpleString()} | {s: v for s, v in scanned[f.name].items() if s in _STATED}
        if f.name in texts:
            column["layouts"] = {
                fmt: {s: second[f.name, fmt, s] for s in _DATES} for fmt in fitting.get(f.name, ()) if scanned[f.name]["count"]
            }
        if f.name in others:
            values = second["distinct", f.name] if f.name in narrow else None
            column["values"] = None if values is None or len(values) > MAX_CATEGORIES else sorted(values)
        columns[f.name] = column
    return describe_from(df, {"rows": row_count, "columns": columns}, infer_strings, had_gaps, approx, scanned)


_DATES = ("min_date", "max_date", "range_days")
_STATED = ("count", "null_count", "mean", "std", "min", "max", "sum", *_DATES)


def describe_from(
    df: DataFrame,
    state: State,
    infer_strings: bool = True,
    had_gaps: Collection[str] = (),
    approx: bool = False,
    scanned: Mapping[str, Mapping[str, Any]] | None = None,
) -> Described:
    """As ``describe``, from the table's state: nothing is scanned until more of the profile is read."""
    fields = data_fields(df)
    columns = state["columns"]
    if {n: c["dtype"] for n, c in columns.items()} != {f.name: f.dataType.simpleString() for f in fields}:
        raise ValueError("the state is that of another table")
    present = {n: (c["count"], c["count"] + c["null_count"]) for n, c in columns.items()}
    layouts = {n: c["layouts"] for n, c in columns.items() if c.get("layouts") and infer_strings}
    formats = {n: next(iter(found)) for n, found in layouts.items()}
    distinct = {n: len(c["values"]) for n, c in columns.items() if c.get("values") is not None}
    types = classify(fields, present, formats, distinct, infer_strings, had_gaps)
    rows = []
    for t in types:
        column = columns[t.column]
        row = {"column": t.column, **(scanned or {}).get(t.column, {}), **{s: column[s] for s in _STATED if s in column}}
        if t.column in formats:
            row |= layouts[t.column][formats[t.column]]
        elif t.column in distinct:
            row["unique_count"] = distinct[t.column]
        rows.append({**row, "position": t.position, "type": t.semantic_type})
    by_name = {r["column"]: r for r in rows}
    numeric = [f.name for f in fields if is_numeric(f.dataType)]
    others = [f.name for f in fields if not (is_numeric(f.dataType) or is_temporal(f.dataType)) and f.name not in formats]

    def complete() -> None:
        if approx and not scanned:
            for n, found in scan_columns(df, numeric, {}, approx).items():
                by_name[n] |= found
        add_values(df, others, by_name, approx)
        add_quantiles(df, numeric, by_name, approx)

    return Described(df.sparkSession, types, rows, state["rows"], complete, state)


def position_of(df: DataFrame, order_by: Sequence[str] | None) -> Column:
    """Row order for "first rows": the given columns, or the ingestion position."""
    if order_by:
        return F.struct(*[col(c) for c in order_by])
    if POSITION in df.columns:
        return col(POSITION)
    return F.monotonically_increasing_id()


def auto_charts(
    df: DataFrame, described: Described, order: Column, skipped: list[tuple[str, str]] | None = None
) -> list[C.Chart]:
    """Up to four charts: over time, by category, distribution, relation.

    What does not fit the table is added to ``skipped``.
    """
    kinds, rows = described.kinds, described.basics
    numbers = kinds["numeric"]
    number = best_numeric(rows)
    category = best_categorical(rows)
    batch = C.Batch(df)
    found: list[C.Chart] = []

    def add(kind: str, title: str, x: str, y: str | None, data: DataFrame, shared: int | None = None) -> C.Chart:
        both = None if shared is None else (batch, shared)
        found.append(C.Chart(f"auto_{len(found) + 1}", kind, title, x, y, data, shared=both))
        return found[-1]

    if kinds["date"] and numbers:
        date = kinds["date"][0]
        shared = batch.add(date, number, "mean", C.LINE_POINTS)
        add("line", f"{number} over time", date, number, C.line_chart(df, date, number), shared)
    if category and numbers:
        shared = batch.add(category, number, "mean", C.BAR_GROUPS, by_value=True)
        add("bar", f"{number} by {category}", category, number, C.bar_chart(df, category, number), shared)
    if numbers:
        facts = next(r for r in rows if r["column"] == number)
        edges = None
        try:
            # The profile knows the range.
            edges = C.bin_edges(number, facts["count"], facts["min"], facts["max"])
        except C.Skipped as reason:
            if skipped is not None:
                skipped.append((f"auto_{len(found) + 1}", str(reason)))
        if edges is not None:
            bins = C.histogram_of(df, number, edges).select("label", "y")
            add("bar", f"Distribution of {number}", number, "rows", bins, batch.add_histogram(number, edges))
    if len(numbers) >= 2:
        other = best_numeric(rows, exclude=[number])
        if other != number:
            points = C.scatter_points(df, number, other, order)
            add("scatter", f"{number} vs {other}", number, other, points).told = _correlation_of(points)
    return found


def _correlation_of(points: DataFrame) -> Callable[[], str]:
    """The text about plotted points, computed when it is read."""

    def told() -> str:
        corr = C.points_correlation(points).first()[0]
        return f"Correlation: {None if corr is None else round(corr, 2)}."

    return told


def basic_insights(described: Described) -> list[Insight]:
    """Summary of the best number, the best category and the next best number."""
    rows, kinds = described.basics, described.kinds
    found: list[Insight] = []

    def summary(column: str, names: Sequence[str]) -> None:
        stats = described.stats(column)
        found.append(Insight("stats", column, f"Summary of {column}", {n: stats.get(n) for n in names}))

    number = best_numeric(rows)
    if number:
        summary(number, ("mean", "median", "min", "max", "sum"))
    category = best_categorical(rows)
    if category:
        top = described.stats(category).get("top_values")
        if top:
            shown = {t["value"]: t["count"] for t in top[:TOP_SHOWN]}
            facts = {
                "value": top[0]["value"],
                "pct": top[0]["pct"],
                "unique_count": described.stats(category)["unique_count"],
            }
            found.append(Insight("top_values", category, f"Values of {category}", shown, facts))
    if len(kinds["numeric"]) >= 2:
        summary(best_numeric(rows, exclude=[number]), ("mean", "min", "max"))
    return found


@dataclass
class Report:
    """Result of an analysis; charts and insights are lazy, everything else is small."""

    dataset_id: str | None
    described: Described
    charts: list[C.Chart]
    find: Callable[[], list[Insight]]
    instructions: Mapping[str, Any] = field(default_factory=dict)
    skipped: list[tuple[str, str]] = field(default_factory=list)

    @cached_property
    def insights(self) -> list[Insight]:
        """The findings, computed when they are first read."""
        return self.find()

    def explanations(self) -> DataFrame:
        """Numbers of the text description, one row."""
        return describe_dataset(self.described.summary())

    def trends(self) -> list[float]:
        return [i.data["change_percent"] for i in self.insights if i.type == "trend"]

    def table(self, name: str) -> DataFrame:
        """One result table: charts, profile, types, insights or explanations; nothing else is computed."""
        spark = self.described.spark
        made = {
            "charts": lambda: C.charts_frame(self.charts),
            "profile": lambda: self.described.profile,
            "types": lambda: types_frame(spark, self.described.types),
            "insights": lambda: insights_frame(spark, self.insights),
            "explanations": self.explanations,
        }
        return made[name]()

    def tables(self) -> dict[str, DataFrame]:
        """All result tables, ready for ``sources.documents.save_results``."""
        names = ["profile", "types", "insights", "explanations", *(["charts"] if self.charts else [])]
        return {name: self.table(name) for name in names}

    def document(self) -> dict[str, Any]:
        """Everything as one dictionary; collects the chart points, but for charts too large to list (see ``Chart.payload``)."""
        return {
            "dataset_id": self.dataset_id,
            "metadata": self.described.metadata(),
            "charts": [c.payload() for c in self.charts],
            "insights": [
                {"type": i.type, "column": i.column, "title": i.title, "data": i.data, "facts": i.facts}
                for i in self.insights
            ],
            "explanations": [self.explanations().first().asDict(), *self.trends()],
            "ai_instructions": dict(self.instructions),
        }


def auto_report(
    df: DataFrame,
    order_by: Sequence[str] | None = None,
    described: Described | None = None,
    dataset_id: str | None = None,
) -> Report:
    """Report chosen from the profile alone."""
    described = described or describe(df)
    skipped: list[tuple[str, str]] = []
    found = auto_charts(df, described, position_of(df, order_by), skipped)
    return Report(dataset_id, described, found, lambda: basic_insights(described), skipped=skipped)


def analyze(
    df: DataFrame,
    instructions: Mapping[str, Any] | None = None,
    order_by: Sequence[str] | None = None,
    described: Described | None = None,
    dataset_id: str | None = None,
) -> Report:
    """Charts and insights by instruction; without any, by rule.

    The table is not cached: each chart reads only its own columns again,
    which costs less than keeping a large table in memory.
    """
    described = described or describe(df)
    if instructions is None:
        instructions = suggest_instructions(described.types, described.row_count)
    order = position_of(df, order_by)
    charts, skipped = C.build_charts(df, instructions.get("charts", []), order)
    if not charts:
        charts = auto_charts(df, described, order, skipped)
    plans, failed = plan_analyses(df, instructions.get("analyses", []))

    def find() -> list[Insight]:
        insights = [insight for plan in plans if (insight := plan())]
        return insights if len(insights) >= ENOUGH_INSIGHTS else top_up(insights, basic_insights(described))

    return Report(dataset_id, described, charts, find, instructions, skipped + failed)
