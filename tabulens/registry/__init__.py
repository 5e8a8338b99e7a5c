"""Named queries over the test tables, each with the SQL that must agree with it."""

from tabulens.registry import checks, figures, profiles, records, stores  # noqa: F401
from tabulens.registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
