"""Site, search and training-data analytics as Spark jobs."""
