"""Structured Streaming forms of the guards, counters and the ingestion."""
