"""All ledger queries and their SQL, by name."""

from __future__ import annotations

from .plans import core, dashboard, geometry, imports, models, normal, series, sheets, streams, text  # noqa: F401  they register themselves
from .plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
