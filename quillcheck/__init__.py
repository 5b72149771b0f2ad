"""Query-and-answer evaluation analytics expressed as Spark DataFrame jobs."""
