"""Which columns are worth showing; works on the profile rows, never on the data."""

from __future__ import annotations

import math
from collections.abc import Collection, Iterable, Mapping
from typing import Any

from tabulens.functions.scalars import ID_FRAGMENTS

# A column to compare by has this many distinct values.
MIN_GROUPS = 2
MAX_GROUPS = 20

Rows = Iterable[Mapping[str, Any]]


def variation_of(row: Mapping[str, Any]) -> float:
    """Signed std / mean of the displayed statistics; 0 without a mean."""
    mean, std = (round(row.get(s) or 0.0, 4) for s in ("mean", "std"))
    return std / mean if mean else 0.0


def best_numeric(profile: Rows, exclude: Collection[str] = ()) -> str | None:
    """Number that varies most relative to its mean, the first one on ties.

    Columns named like identifiers do not take part.  The first column wins
    unless another beats both it and -1.  A variation that is not a number, as
    infinite values give, beats nothing.
    """
    numbers = [
        r for r in profile if r["type"] in ("integer", "float") and r["column"] not in exclude
    ]
    if not numbers:
        return None
    open_to_choice = [
        r for r in numbers if not any(f in r["column"].lower() for f in ID_FRAGMENTS)
    ]
    comparable = [r for r in open_to_choice if not math.isnan(variation_of(r))]
    best = max(comparable, key=variation_of, default=numbers[0])
    return best["column"] if variation_of(best) > -1 else numbers[0]["column"]


def best_categorical(profile: Rows) -> str | None:
    """First categorical, then first other column with a handful of values."""
    fitting = [
        r
        for r in profile
        if r["type"] in ("categorical", "text", "boolean")
        and MIN_GROUPS <= (r.get("unique_count") or 0) <= MAX_GROUPS
    ]
    # The sort is stable, so table order decides within a kind.
    ranked = sorted(fitting, key=lambda r: r["type"] != "categorical")
    return ranked[0]["column"] if ranked else None
