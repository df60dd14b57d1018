"""Structured Streaming forms of ingestion, alerts and limits."""
