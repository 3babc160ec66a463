"""Event-data analytics as Spark DataFrame jobs."""
