"""Temporal hypergraph analytics and corpus preparation on Spark."""
