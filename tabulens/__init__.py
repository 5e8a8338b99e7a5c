"""Automatic profiling, charting and insight extraction for Spark tables."""

from tabulens.plans.ingest import ingest, open_dataset
from tabulens.plans.report import analyze, auto_report

__all__ = ["analyze", "auto_report", "ingest", "open_dataset"]
