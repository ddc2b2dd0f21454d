"""lodeworks: catalogue analytics as Spark DataFrame and SQL transforms."""
