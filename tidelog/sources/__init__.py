"""Durable state of a store: lock, manifest, write-ahead log, sorted Parquet runs, reports."""
