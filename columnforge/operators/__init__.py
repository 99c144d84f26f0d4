"""Operators on batches and tables."""
