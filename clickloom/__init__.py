"""Clickstream analytics as plain Spark DataFrame and Structured Streaming operators."""
