"""Queries over the driver's tables, one for each operator or group of operators, with SQL for the same rows."""

from tessera.plans import analytics, evaluating, filings, learning, retrieval  # noqa: F401
from tessera.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
