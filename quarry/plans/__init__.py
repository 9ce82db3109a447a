"""Filters compiled to columns."""
