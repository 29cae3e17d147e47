"""Registered queries; importing this package registers all."""

from . import audit_queries, graph_queries, trust_queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "audit_queries", "graph_queries", "trust_queries"]
