"""Hypergraph analytics and negative sampling as Spark DataFrame operations."""
