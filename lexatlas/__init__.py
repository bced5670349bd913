"""Section-level ingestion and hybrid retrieval on Spark."""
