"""Document retrieval and text analytics expressed as Spark DataFrame jobs."""
