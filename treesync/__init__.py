"""Spark jobs for very large file and object inventories (see README.md)."""
