"""Incremental arrival of image files as Structured Streaming jobs."""
