"""functions of paperloom."""
