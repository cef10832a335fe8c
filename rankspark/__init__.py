"""Ranked retrieval on Spark: BM25 over any-of-these-terms queries."""

from .operators.search import Collection, Queries, any_of, queries_from_text
from .plans.index import Index, StaleIndexError
from .ship import ship

__all__ = ["Collection", "Index", "Queries", "StaleIndexError", "any_of", "queries_from_text", "ship"]
