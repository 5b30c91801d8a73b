"""Column functions: text, scalars, list matching."""
