"""Catalog analytics expressed as Spark DataFrame jobs."""
