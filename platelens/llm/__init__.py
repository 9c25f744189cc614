"""Operators of large training-data pipelines: extraction, dedup, filters, scoring, packing."""
