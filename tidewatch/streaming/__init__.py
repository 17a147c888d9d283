"""Structured Streaming over interval records."""
