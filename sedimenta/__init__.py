"""Spark-first ingestion, profiling, matching and validation of loosely structured data."""
