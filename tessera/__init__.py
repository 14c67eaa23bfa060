"""Typo-tolerant ranked text search over Spark DataFrames."""
