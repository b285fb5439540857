"""Structured Streaming: replay, enrichment, windows."""
