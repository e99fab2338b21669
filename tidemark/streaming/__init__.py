"""Structured Streaming pipelines and the stateful processor."""
