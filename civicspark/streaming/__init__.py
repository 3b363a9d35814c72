"""Incremental loading with Structured Streaming, retry queue rewrite."""
