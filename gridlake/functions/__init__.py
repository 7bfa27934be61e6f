"""Column expressions and small table helpers."""
