"""Operators of a training-data pipeline: packing, deduplication, filtering, scoring, archives."""
