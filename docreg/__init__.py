"""Document-field extraction and record registries as Spark jobs."""
