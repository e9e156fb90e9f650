"""Structured Streaming front doors of the batch operators."""
