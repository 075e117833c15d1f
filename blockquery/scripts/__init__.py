"""Spark jobs over a table of pipeline scripts."""
