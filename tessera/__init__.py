"""Spark analytics for matching noisy business records across sources."""
