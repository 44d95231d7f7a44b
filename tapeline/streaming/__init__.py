"""Structured Streaming jobs over quotes."""
