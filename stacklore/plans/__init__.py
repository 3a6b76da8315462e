"""Registered queries over the test tables."""

from stacklore.plans import (  # noqa: F401 - importing registers the queries
    catalogue_queries,
    scoring_queries,
    search_queries,
    stream_queries,
    text_queries,
)
from stacklore.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
