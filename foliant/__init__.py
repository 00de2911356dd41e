"""Document structure, retrieval and review analytics as Spark DataFrame jobs."""
