"""Column expressions and ordering helpers."""
