"""Structured Streaming variants of the batch tables."""
