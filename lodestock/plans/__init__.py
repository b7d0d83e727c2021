"""Registered queries."""

from . import catalog_queries, change_queries, file_queries, provider_queries, retrieval_queries, review_queries, run_queries, search_queries, stock_queries, stream_queries, text_queries, validator_queries, version_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
