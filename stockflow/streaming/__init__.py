"""Structured Streaming jobs for the append-only feeds."""
