"""Operators of a training-data pipeline: tokens, filters, duplicates, archives."""
