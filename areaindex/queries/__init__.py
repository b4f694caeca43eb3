"""Registered queries over the given tables, each with its SQL twin where SQL can say it."""

from areaindex.queries import geography, index, indicators, ranking, services, sources  # noqa: F401
from areaindex.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
