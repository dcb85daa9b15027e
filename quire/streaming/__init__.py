"""Streaming forms (beyond the batch pipeline)."""
