"""Streaming ingest of events."""
