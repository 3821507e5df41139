"""Spark-native search and analytics over collections of code and text."""

from siftwell.runtime import cut_lineage, number_rows, session

__all__ = ["cut_lineage", "number_rows", "session"]
