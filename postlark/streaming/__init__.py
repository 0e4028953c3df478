"""Continuous ingest and status updates over append-only tables."""
