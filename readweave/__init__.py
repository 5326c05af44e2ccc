"""Barcode-aware sequencing analytics on Spark: every operation is a function from DataFrames to DataFrames."""

__version__ = "0.1.0"
