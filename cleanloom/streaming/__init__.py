"""Structured Streaming: ingest counters and replay of fitted recipes."""
