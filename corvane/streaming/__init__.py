"""Incremental and resumable variants on Structured Streaming."""
