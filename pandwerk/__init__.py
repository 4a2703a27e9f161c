"""Building-register analytics as Spark DataFrame jobs."""
