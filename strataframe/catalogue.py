"""Every registered query of the engine and its SQL."""

from __future__ import annotations

from .plans import analytic_queries, cell_queries, join_queries, kernel_queries, raster_queries, study_queries  # noqa: F401 - they register
from .plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
