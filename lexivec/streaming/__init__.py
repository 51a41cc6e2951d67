"""Continuous forms of indexing and embedding."""
