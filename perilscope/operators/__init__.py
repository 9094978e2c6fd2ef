"""Transformations from DataFrame to DataFrame."""
