"""All queries of this package."""

from stratablock.plans import admin_queries, block_queries, item_queries, journal_queries, layer_queries, stream_queries  # noqa: F401
from stratablock.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
