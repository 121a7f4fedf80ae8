"""Operators of the activity engine."""
