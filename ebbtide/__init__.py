"""Ebbtide: market screening as Spark jobs over long tables and streams."""

__version__ = "0.1.0"
