"""Operators on training data."""
