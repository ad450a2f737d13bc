"""Operators of a training-data pipeline: sharding, filtering, deduplication, scoring and encoding of texts."""
