"""Queries over the driver's tables and their SQL, by name."""

from brindle.plans.match_queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
