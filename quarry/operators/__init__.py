"""Operators over frames: query chain, grouping, search, writes."""
