"""Marker discovery on Spark: presence tables in, stable markers out."""

__version__ = "0.1.0"
