"""Operators of training-data pipelines: deduplication, search, filters, tokens and packing."""
