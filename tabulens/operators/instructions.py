"""Instruction rows out of a table of raw model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.functions.columns import col

# Defaults of a missing field; {} stands for the 1-based position.
MAX_INSIGHTS = 6
INSIGHT_DEFAULTS = {
    "id": "insight_{}",
    "title": "Insight {}",
    "description": "",
    "type": "comparison",
    "feasibility": "medium",
}
CHART_DEFAULTS = {
    "id": "chart_{}",
    "type": "bar",
    "title": "Graphique {}",
    "aggregation": "sum",
    "description": "",
}
ANALYSIS_DEFAULTS = {
    "id": "analysis_{}",
    "type": "groupby",
    "description": "",
    "aggregation": "sum",
}

_SPACES = " \t\n\r\f\x0b"
_SECTIONS = ("insights", "charts", "analyses")


def _strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACES))


def _without_fence(text: Column) -> Column:
    """Drop the first and last line of a text that opens with three backticks."""
    lines = F.split(text, "\n")
    inner = F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0))), "\n")
    return F.when(text.startswith("```"), _strip(inner)).otherwise(text)


def _is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def _list_ok(document: Column, section: str) -> Column:
    """Missing, or a list of objects (only the insights that are kept matter)."""
    path = f"$.{section}"
    present = F.try_variant_get(document, path, "variant").isNotNull()
    items = F.try_variant_get(document, path, "array<variant>")
    if section == "insights":
        items = F.slice(items, 1, MAX_INSIGHTS)
    return ~present | F.coalesce(F.forall(items, _is_object), F.lit(False))


def parse_answers(answers: DataFrame, key: str, text: str) -> DataFrame:
    """``<key>, document, parsed``: the JSON object of each answer.

    The whole answer is tried first, then the part from the first opening to
    the last closing brace.  An answer without a well-formed object gets an
    empty document and ``parsed = false``.
    """
    bare = _without_fence(_strip(col(text)))
    braces = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    document = F.coalesce(F.try_parse_json(bare), F.try_parse_json(F.when(braces != "", braces)))
    found = answers.select(col(key), document.alias("document"))
    usable = _is_object(F.col("document"))
    for section in _SECTIONS:
        usable = usable & _list_ok(F.col("document"), section)
    return found.withColumn("parsed", F.coalesce(usable, F.lit(False))).withColumn(
        "document", F.when(F.col("parsed"), F.col("document")).otherwise(F.parse_json(F.lit("{}")))
    )


def answer_summaries(parsed: DataFrame, key: str) -> DataFrame:
    return parsed.select(col(key), "parsed", _field("document", "summary", F.lit("")).alias("summary"))


def _field(item: str, name: str, default: Column) -> Column:
    """The field as text; the default only where it is absent, not where it is null."""
    value = F.col(item)
    absent = F.try_variant_get(value, f"$.{name}", "variant").isNull()
    return F.when(absent, default).otherwise(F.try_variant_get(value, f"$.{name}", "string"))


def _names(item: str, name: str) -> Column:
    values = F.try_variant_get(F.col(item), f"$.{name}", "array<string>")
    return F.coalesce(values, F.array().cast("array<string>"))


def _items(parsed: DataFrame, key: str, section: str, limit: int | None = None) -> DataFrame:
    items = F.try_variant_get(F.col("document"), f"$.{section}", "array<variant>")
    if limit:
        items = F.slice(items, 1, limit)
    return parsed.select(col(key), F.posexplode(items).alias("at", "item")).withColumn(
        "position", F.col("at") + 1
    )


def _filled(defaults: dict[str, str]) -> list[Column]:
    return [
        _field("item", n, F.format_string(d.replace("{}", "%d"), "position") if "{}" in d else F.lit(d)).alias(
            n
        )
        for n, d in defaults.items()
    ]


def insight_rows(parsed: DataFrame, key: str) -> DataFrame:
    """One row per suggested insight, at most six per answer."""
    items = _items(parsed, key, "insights", MAX_INSIGHTS)
    return items.select(
        col(key),
        "position",
        *_filled(INSIGHT_DEFAULTS),
        _names("item", "required_columns").alias("required_columns"),
    )


def chart_rows(parsed: DataFrame, key: str) -> DataFrame:
    """One row per suggested chart; axes have no default."""
    axes = [_field("item", n, F.lit(None).cast("string")).alias(n) for n in ("x", "y")]
    return _items(parsed, key, "charts").select(
        col(key), "position", *_filled(CHART_DEFAULTS), *axes
    )


def analysis_rows(parsed: DataFrame, key: str) -> DataFrame:
    """One row per suggested analysis."""
    return _items(parsed, key, "analyses").select(
        col(key), "position", *_filled(ANALYSIS_DEFAULTS), _names("item", "columns").alias("columns")
    )


def instructions_of(parsed: DataFrame, key: str, value) -> dict:
    """Instruction dictionary of one answer, ready for ``plans.report.analyze``."""
    one = parsed.where(col(key) == F.lit(value))

    def rows(table: DataFrame) -> list[dict]:
        listed = [r.asDict() for r in table.orderBy("position").collect()]
        return [{n: v for n, v in r.items() if n not in (key, "position")} for r in listed]

    summary = answer_summaries(one, key).first()
    return {
        "insights": rows(insight_rows(one, key)),
        "charts": rows(chart_rows(one, key)),
        "analyses": rows(analysis_rows(one, key)),
        "summary": summary["summary"] if summary else "",
    }
