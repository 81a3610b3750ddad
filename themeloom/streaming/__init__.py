"""Incremental variants of the append-only answer collection."""
