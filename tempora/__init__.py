"""Tempora: a PySpark-native engine for versioned, bitemporal, semi-structured data."""

__version__ = "0.1.0"
