"""Operators of a training-data pipeline: packing, scoring, mixing, similarity, formatting, archives, filtering."""
