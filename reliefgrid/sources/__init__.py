"""Readers, writers and the dimensions shipped with the package."""
