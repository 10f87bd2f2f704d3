"""Registered queries over the driver tables, each beside its SQL counterpart."""

from statloom.catalog import jobs, landed, models, panel, relational, series  # noqa: F401
from statloom.catalog.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
