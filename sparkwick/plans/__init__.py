"""Registered queries and the SQL that checks them."""

from sparkwick.plans import (  # noqa: F401
    candle_plans,
    decision_plans,
    learning_plans,
    monitor_plans,
    structure_plans,
    vector_plans,
)
from sparkwick.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
