"""Sequence similarity on Spark: sets of strings, searches by distance, and distances of pairs."""
