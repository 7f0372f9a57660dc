"""Importing this package registers every query."""

from metricloom.plans import (  # noqa: F401
    catalog_clean,
    catalog_metrics,
    catalog_process,
    catalog_profile,
    catalog_sources,
    catalog_stats,
    catalog_tables,
    catalog_text,
)
from metricloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
