"""Operators composed to whole jobs."""
