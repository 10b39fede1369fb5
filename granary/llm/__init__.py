"""Operators for preparing training data: sharding, scoring, filtering, deduplication, packing and search."""
