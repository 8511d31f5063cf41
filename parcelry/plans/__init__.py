"""Registered queries over the driver's tables, with their SQL."""

from . import campaign_queries, compare_queries, prepare_queries, spatial_queries, store_queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "campaign_queries", "compare_queries", "prepare_queries", "spatial_queries", "store_queries"]
