"""Keyword (tag) extraction from question posts, written as Spark jobs."""
