"""All queries of the engine, by name."""

from __future__ import annotations

from .plans import aggregates, imaging, joins, kernels, parameters, scalars, scans, selections, tiles  # noqa: F401  they register themselves
from .plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
