"""Incremental processing of landing folders with Structured Streaming."""
