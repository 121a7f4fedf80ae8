"""Streaming of the activity engine."""
