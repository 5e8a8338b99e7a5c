"""Single findings: trend, top groups, correlation, column summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulens.functions.columns import data_columns, field_type, is_numeric, is_summable
from tabulens.functions.scalars import exact_round, percent, safe_corr
from tabulens.operators.charts import Skipped, filled, group_values, labelled, number

# Sizes and thresholds of the findings.
TOP_GROUPS = 5
TOP_SHOWN = 6
STRONG = 0.7
MODERATE = 0.4
ENOUGH_INSIGHTS = 2


@dataclass
class Insight:
    """A finding with its numbers; ``column`` is set for column summaries.

    ``facts`` describe the finding as a whole where ``data`` lists values.
    """

    type: str
    column: str | None
    title: str
    data: dict[str, Any] = field(default_factory=dict)
    facts: dict[str, Any] = field(default_factory=dict)


def trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """``groups, first_total, last_total, change_percent, direction``.

    Totals of ``y`` at the lowest and the highest key; no row with fewer than
    two keys, change 0 when the first total is 0.
    """
    ends = group_values(df, x, y).agg(
        F.count(F.lit(1)).alias("groups"),
        F.min_by("y", "key").alias("first_total"),
        F.max_by("y", "key").alias("last_total"),
    )
    change = percent(F.col("last_total") - F.col("first_total"), F.col("first_total"))
    return (
        ends.where(F.col("groups") >= 2)
        .withColumn("change_percent", F.coalesce(exact_round(change, 1), F.lit(0.0)))
        .withColumn(
            "direction", F.when(F.col("change_percent") > 0, "increased").otherwise("decreased")
        )
    )


def top_groups(df: DataFrame, x: str, y: str) -> DataFrame:
    """``label, y``: the groups with the highest sums."""
    best = group_values(df, x, y).orderBy(F.desc("y"), "key").limit(TOP_GROUPS)
    return labelled(df, x, best)


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """``correlation, strength, direction`` over all complete pairs."""
    pairs = filled(df, x, y).select(number(df, x).alias("x"), number(df, y).alias("y"))
    r = F.col("correlation")
    return (
        pairs.agg(exact_round(safe_corr(F.col("x"), F.col("y")), 3).alias("correlation"))
        .withColumn(
            "strength",
            F.when(F.abs(r) > STRONG, "strong").when(F.abs(r) > MODERATE, "moderate").otherwise("weak"),
        )
        .withColumn("direction", F.when(r > 0, "positive").otherwise("negative"))
    )


def plan_analysis(df: DataFrame, analysis: Mapping[str, Any]) -> Callable[[], Insight | None] | None:
    """What finds the answer to one request; None if there is nothing to ask, ``Skipped`` if it cannot run."""
    names = data_columns(df)
    known = [c for c in analysis.get("columns", []) if c in names]
    if len(known) < 2:
        return None
    x, y = known[:2]
    kind, title = analysis.get("type"), analysis.get("description", "")
    if kind in ("trend", "groupby") and not is_summable(field_type(df, y)):
        raise Skipped(f"{y} is not numeric")

    def find_trend() -> Insight | None:
        row = trend(df, x, y).first()
        data = row and {"change_percent": row["change_percent"], "direction": row["direction"]}
        return Insight("trend", None, title, data) if row else None

    def find_groups() -> Insight:
        rows = top_groups(df, x, y).collect()
        return Insight("groupby", None, title, {r["label"]: round(r["y"], 2) for r in rows})

    def find_correlation() -> Insight:
        return Insight("correlation", None, title, correlation(df, x, y).first().asDict())

    if kind == "correlation" and not (is_numeric(field_type(df, x)) and is_numeric(field_type(df, y))):
        return None
    return {"trend": find_trend, "groupby": find_groups, "correlation": find_correlation}.get(kind)


def plan_analyses(
    df: DataFrame, analyses: Iterable[Mapping[str, Any]]
) -> tuple[list[Callable[[], Insight | None]], list[tuple[str, str]]]:
    """What finds the answers in request order, and ``(analysis id, reason)`` of requests that cannot run; no job."""
    plans: list[Callable[[], Insight | None]] = []
    skipped: list[tuple[str, str]] = []
    for number, analysis in enumerate(analyses, 1):
        try:
            plan = plan_analysis(df, analysis)
        except Skipped as reason:
            skipped.append((analysis.get("id", f"analysis_{number}"), str(reason)))
            continue
        if plan:
            plans.append(plan)
    return plans, skipped


def run_analyses(
    df: DataFrame, analyses: Iterable[Mapping[str, Any]]
) -> tuple[list[Insight], list[tuple[str, str]]]:
    """Findings in request order, and ``(analysis id, reason)`` of those that cannot run."""
    plans, skipped = plan_analyses(df, analyses)
    return [found for plan in plans if (found := plan())], skipped


def top_up(found: list[Insight], basics: list[Insight]) -> list[Insight]:
    """Add column summaries to a short list, unless one of that column and type is there."""
    if len(found) >= ENOUGH_INSIGHTS:
        return found
    merged = list(found)
    for basic in basics:
        if all((i.column, i.type) != (basic.column, basic.type) for i in merged):
            merged.append(basic)
    return merged


def insights_frame(spark: SparkSession, insights: list[Insight]) -> DataFrame:
    """``position, type, column, title, key, number, text``: one row per reported value.

    Facts about the whole finding have ``_facts`` after its type.
    """
    rows = []
    for position, insight in enumerate(insights, 1):
        for kind, values in ((insight.type, insight.data), (f"{insight.type}_facts", insight.facts)):
            for key, value in values.items():
                figure = float(value) if isinstance(value, (int, float)) else None
                text = value if isinstance(value, str) else None
                rows.append((position, kind, insight.column, insight.title, key, figure, text))
    return spark.createDataFrame(
        rows,
        "position int, type string, column string, title string, key string, number double, text string",
    )
