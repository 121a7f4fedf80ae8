"""Sources of the activity engine."""
