"""What the automatic choices need to know about a table, as a small value that merges.

A state has for every column the counts, moments and range of its numbers, the
range of its dates, the layouts that all its texts follow with the range under
each, and the different values as long as there are few. The state of two tables'
union follows from theirs, so a dataset that grows by parts needs no new scan, and
one that is stored with its state needs none to be opened.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from datetime import datetime
from typing import Any

State = dict[str, Any]

#: Values that a state lists; with more the list is given up for good.
LISTED = 50


def merged(a: State, b: State) -> State:
    """The state of the union of two tables with the same columns."""
    if {n: c["dtype"] for n, c in a["columns"].items()} != {n: c["dtype"] for n, c in b["columns"].items()}:
        raise ValueError("the tables differ in their columns")
    columns = {n: _merged_column(a["columns"][n], b["columns"][n]) for n in a["columns"]}
    return {"rows": a["rows"] + b["rows"], "columns": columns}


def _merged_column(a: Mapping[str, Any], b: Mapping[str, Any]) -> dict[str, Any]:
    made = {"dtype": a["dtype"], "count": a["count"] + b["count"], "null_count": a["null_count"] + b["null_count"]}
    # A side without values has no say in what the other one holds.
    one = b if not a["count"] else a if not b["count"] else None
    if "mean" in a:
        made |= {s: one[s] for s in ("mean", "std", "min", "max", "sum")} if one else _merged_numbers(a, b)
    if "min_date" in a:
        made |= {s: one[s] for s in ("min_date", "max_date", "range_days")} if one else _merged_dates(a, b)
    if "layouts" in a:
        both = [fmt for fmt in a["layouts"] if fmt in b["layouts"]]
        made["layouts"] = one["layouts"] if one else {f: _merged_dates(a["layouts"][f], b["layouts"][f]) for f in both}
    if "values" in a:
        lists = (a["values"], b["values"])
        values = None if None in lists else sorted({*a["values"], *b["values"]})
        made["values"] = None if values is None or len(values) > LISTED else values
    return made


def _merged_numbers(a: Mapping[str, Any], b: Mapping[str, Any]) -> dict[str, Any]:
    n, m = a["count"], b["count"]
    apart = b["mean"] - a["mean"]
    # A single value has no deviation of its own.
    squares = sum((c["std"] or 0.0) ** 2 * (c["count"] - 1) for c in (a, b)) + apart * apart * n * m / (n + m)
    return {
        "mean": a["mean"] + apart * m / (n + m) if math.isfinite(apart) else a["mean"] + b["mean"],
        "std": math.sqrt(squares / (n + m - 1)),
        "min": min(a["min"], b["min"]),
        "max": max(a["max"], b["max"]),
        "sum": a["sum"] + b["sum"],
    }


def _merged_dates(a: Mapping[str, Any], b: Mapping[str, Any]) -> dict[str, Any]:
    first, last = min(a["min_date"], b["min_date"]), max(a["max_date"], b["max_date"])
    days = (datetime.fromisoformat(last) - datetime.fromisoformat(first)).days
    return {"min_date": first, "max_date": last, "range_days": days}
