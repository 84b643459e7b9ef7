"""Halyard: imaging-archive queries and corpus preparation as plain Spark jobs."""
