"""Readers: files, streams, databases, change feeds, and the test-table adapter."""
