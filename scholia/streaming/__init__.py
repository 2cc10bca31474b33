"""Incremental ingest with checkpoints."""
