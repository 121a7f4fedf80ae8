"""Plans of the activity engine."""
