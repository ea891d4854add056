"""Operators on unbounded input."""
