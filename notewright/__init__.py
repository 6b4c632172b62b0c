"""Project-memory curation as Spark DataFrame jobs."""
