"""Versioned, labelled, index-sorted tables and time series on PySpark."""

__version__ = "0.1.0"
