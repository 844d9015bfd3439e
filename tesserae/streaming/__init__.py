"""Incremental counterparts of the mergeable aggregates."""
