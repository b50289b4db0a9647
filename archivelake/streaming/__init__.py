"""Incremental ingest of folders and event streams."""
