"""Spark jobs for software-distribution archives."""
