"""Evidence search and timeline analytics on Spark."""
