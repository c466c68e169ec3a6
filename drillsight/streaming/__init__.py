"""Structured Streaming jobs on the click stream."""
