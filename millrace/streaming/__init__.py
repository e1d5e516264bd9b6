"""Incremental fits on Structured Streaming."""
