"""Operators of a training-data pipeline: mixing, packing, dedup, filters, classifiers, exact search."""
