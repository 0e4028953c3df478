"""Landed raw payloads to postings."""
