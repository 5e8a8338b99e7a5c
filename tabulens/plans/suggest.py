"""Rule-based instructions for a table nobody described."""

from __future__ import annotations

from typing import Any

from tabulens.operators.types import ColumnType, by_kind


# The ids, types, feasibility, aggregations and order of the suggestions below.
def suggest_instructions(types: list[ColumnType], rows: int = 0) -> dict[str, Any]:
    """Insights, charts and analyses on the first column of each kind."""
    kinds = by_kind(types)
    numbers = kinds["numeric"]
    number = numbers[0] if numbers else None
    date = kinds["date"][0] if kinds["date"] else None
    category = kinds["categorical"][0] if kinds["categorical"] else None
    insights: list[dict] = []
    charts: list[dict] = []
    analyses: list[dict] = []

    def insight(i: int, title: str, kind: str, feasibility: str, *columns: str) -> None:
        insights.append(
            {
                "id": f"insight_{i}",
                "title": title,
                "description": f"{title}.",
                "type": kind,
                "feasibility": feasibility,
                "required_columns": list(columns),
            }
        )

    def chart(i: int, kind: str, title: str, x: str, y: str, how: str) -> None:
        charts.append(
            {
                "id": f"chart_{i}",
                "type": kind,
                "title": title,
                "x": x,
                "y": y,
                "aggregation": how,
                "description": f"{title}.",
            }
        )

    def analysis(i: int, kind: str, title: str, x: str, y: str) -> None:
        analyses.append(
            {
                "id": f"analysis_{i}",
                "type": kind,
                "description": title,
                "columns": [x, y],
                "aggregation": "sum",
            }
        )

    if date and number:
        insight(1, f"{number} over time", "trend", "high", date, number)
        chart(1, "line", f"{number} over time", date, number, "sum")
        analysis(1, "trend", f"{number} by {date}", date, number)
    if category and number:
        insight(2, f"{number} by {category}", "comparison", "high", category, number)
        chart(2, "bar", f"{number} by {category}", category, number, "sum")
        analysis(2, "groupby", f"{number} by {category}", category, number)
    if number:
        insight(3, f"Distribution of {number}", "distribution", "high", number)
    if len(numbers) >= 2:
        insight(4, f"{number} and {numbers[1]}", "comparison", "medium", number, numbers[1])
        chart(3, "scatter", f"{number} vs {numbers[1]}", number, numbers[1], "none")
    return {
        "insights": insights,
        "charts": charts,
        "analyses": analyses,
        "summary": f"Automatic analysis of {rows} rows and {len(types)} columns.",
    }
