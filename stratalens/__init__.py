"""Text-intelligence analytics as Spark DataFrame transformations."""
