"""Structured Streaming forms of ingest, content-hash dedupe and latest value."""
