"""Catalogue of runnable queries."""

from murmur.catalog import (  # noqa: F401
    corpus_queries,
    eval_queries,
    graph_queries,
    log_queries,
    plan_queries,
    stream_queries,
    text_queries,
    vector_queries,
)
from murmur.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
