"""Incremental ingestion of announcements with Structured Streaming."""
