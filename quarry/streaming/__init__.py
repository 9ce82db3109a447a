"""Streams that feed collections."""
