"""Operators of a training-data pipeline: scoring, deduplication, mixing, packing, counting and scanning of texts."""
