"""Queries over the given tables, and the same results stated in SQL."""
