"""Structured Streaming forms of the reports, ingest and stream joins."""
