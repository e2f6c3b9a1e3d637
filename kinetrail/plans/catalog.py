"""Registered queries of the trajectory operators and their oracle SQL."""

from __future__ import annotations

from kinetrail.plans import action_queries, evaluation_queries, further_queries, log_queries, relational_queries, scene_queries, temporal_queries, wider_queries  # noqa: F401  (they register)
from kinetrail.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
