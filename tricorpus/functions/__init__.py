"""Column expressions and pluggable models."""
