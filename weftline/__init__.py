"""Web-corpus and store analytics as Spark DataFrame jobs."""
