"""Gridded-surface analytics as lazy PySpark DataFrame transformations."""
