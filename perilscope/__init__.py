"""Incident risk analytics as Spark DataFrame transformations."""
