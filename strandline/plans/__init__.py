"""Composed reports and the queries over the shared tables."""
