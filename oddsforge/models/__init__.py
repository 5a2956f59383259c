"""Recommenders re-expressed as distributed Spark jobs."""
