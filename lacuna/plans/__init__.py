"""Registered queries of the library and the SQL that says the same, by name."""

from lacuna.plans import documents, replay, strict  # noqa: F401  register their queries
from lacuna.plans.registry import ORACLES, QUERIES, flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
