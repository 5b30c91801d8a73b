"""Whole pipelines, and the catalogue of queries over the given tables."""
