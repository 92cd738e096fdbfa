"""Structured Streaming forms of the change feeds."""
