"""Versioned, ordered key-value analytics on PySpark DataFrames."""
