"""Incremental forms of the stateless stages."""
