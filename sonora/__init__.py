"""Sound and human-response analytics as Spark jobs."""
