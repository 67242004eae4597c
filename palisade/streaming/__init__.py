"""Structured Streaming versions of ingest, rules and incidents."""
