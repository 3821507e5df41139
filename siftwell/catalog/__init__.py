"""All registered queries; importing this package fills the registry."""

from siftwell.catalog import document_queries, graph_queries, lexical_queries, metric_queries, search_queries, table_queries  # noqa: F401
from siftwell.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
