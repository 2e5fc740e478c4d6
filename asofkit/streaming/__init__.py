"""Incremental loads and event windows on Structured Streaming."""
