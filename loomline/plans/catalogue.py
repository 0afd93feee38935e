"""All queries: importing the modules registers them."""

from . import item_queries, match_queries, record_queries, season_queries, text_queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "item_queries", "match_queries", "record_queries", "season_queries", "text_queries"]
