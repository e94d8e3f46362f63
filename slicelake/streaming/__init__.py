"""Structured Streaming: continuous ingest and keyed slice state."""
