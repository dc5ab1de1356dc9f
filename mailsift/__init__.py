"""Email threat analytics expressed as Spark DataFrame jobs."""
