"""Incremental ingestion, de-duplication, scoring and counts."""
