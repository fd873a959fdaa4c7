"""Readers and writers of the telemetry tables."""
