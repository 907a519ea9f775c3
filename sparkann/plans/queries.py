"""All queries of the engine's own operators; importing the modules registers them."""

from . import analysis_queries, detail_queries, file_queries, index_queries, search_queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "analysis_queries", "detail_queries", "file_queries", "index_queries", "search_queries"]
