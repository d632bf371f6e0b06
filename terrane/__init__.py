"""Elevation change between surveys, and its uncertainty, as Spark plans."""
