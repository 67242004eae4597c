"""Readers, normalisation and the event store."""
