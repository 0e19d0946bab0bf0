"""Raster files as relations, on PySpark."""
