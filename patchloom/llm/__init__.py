"""Operators of a training-data pipeline: decontamination, filtering, scoring, deduplication, mixing and sharding."""
