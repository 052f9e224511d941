"""Quarryline: social-content analytics as Spark DataFrame jobs."""
