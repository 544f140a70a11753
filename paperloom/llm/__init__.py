"""Operators for preparing training data; nothing else in paperloom imports this subpackage."""
