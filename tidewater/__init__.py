"""Event-time feature analytics on Spark: windows, categorical and top-N aggregates, requests, streams and pipelines."""
