"""Functions of the activity engine."""
