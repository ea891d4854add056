"""Density-based topological analysis of vector tables as Spark jobs."""
