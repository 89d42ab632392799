"""Structured Streaming jobs over photos and edits."""
