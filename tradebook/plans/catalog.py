"""Loads every query module, so that the registry is complete."""

from tradebook.plans import (  # noqa: F401
    crawl_queries,
    dedupe_queries,
    file_queries,
    kept_queries,
    metric_queries,
    page_queries,
    record_queries,
    result_queries,
    sites,
    state_queries,
    table_queries,
    texts,
)
from tradebook.plans.registry import QUERIES, TWINS

__all__ = ["QUERIES", "TWINS"]
