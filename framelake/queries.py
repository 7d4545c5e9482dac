"""All registered queries and their SQL."""

from .plans import composites, services  # noqa: F401  register their queries
from .plans.catalog import ORACLES, QUERIES, search_top_k

__all__ = ["ORACLES", "QUERIES", "search_top_k"]
