"""tonearm: recommendation and catalogue analytics as Spark jobs."""
