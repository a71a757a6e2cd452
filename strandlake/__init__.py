"""Transcript identity analytics as Spark DataFrame programs."""
