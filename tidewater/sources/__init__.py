"""Sources: generated, Parquet, Kafka, in-memory, words and HTTP requests."""
