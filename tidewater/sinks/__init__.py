"""Sinks: partitioned Parquet, an in-memory store and a counter; each takes batches and streams."""
