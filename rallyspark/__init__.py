"""rallyspark: Spark jobs for sports-tracking analytics over many clips at once."""
