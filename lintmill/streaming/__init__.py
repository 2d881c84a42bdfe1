"""Incremental runs of the stateless rules."""
