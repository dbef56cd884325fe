"""Registered queries."""

from . import column_queries, graph_queries, log_queries, page_queries, plan_queries  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
