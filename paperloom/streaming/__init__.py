"""streaming of paperloom."""
