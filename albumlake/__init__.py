"""Photo-library analytics on Spark."""
