"""Operators of a training-data pipeline: dedup, search, mixing, filters and packing."""
