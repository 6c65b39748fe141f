"""All registered queries."""

from __future__ import annotations

from boutline.plans import cleaning, history, live, models, scoring, wagers  # noqa: F401
from boutline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
