"""Operators on the long sparse matrix."""
