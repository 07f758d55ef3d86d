"""Registered queries with their SQL: each applies an operator to the tables of a scale-factor directory."""

from . import corpus_queries, layout_queries, order_queries, record_queries, text_queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "corpus_queries", "layout_queries", "order_queries", "record_queries", "text_queries"]
