"""Predicates as trees, and what Spark is asked for them."""
