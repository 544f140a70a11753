"""sources of paperloom."""
