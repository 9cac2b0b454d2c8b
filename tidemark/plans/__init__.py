"""Registered queries: every operator over the given tables, with its SQL counterpart."""

from tidemark.plans import (  # noqa: F401
    checks, feeds, graphs, reports, sinks, streams, values, writes,
)
from tidemark.plans.catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
