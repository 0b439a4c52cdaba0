"""Time-aligned encoding analytics as Spark DataFrame programs."""
