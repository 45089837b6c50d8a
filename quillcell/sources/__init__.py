"""Readers, format checks and writers."""
