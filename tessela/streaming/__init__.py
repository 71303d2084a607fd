"""Incremental counterparts of batch summaries."""
