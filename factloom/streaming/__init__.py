"""Structured Streaming jobs over the committed fact log."""
