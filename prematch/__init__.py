"""Spark jobs for two-sided contests kept as event tables."""
