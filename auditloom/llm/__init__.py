"""Operators of a training-data pipeline: filters, scores, tokens, duplicates, contamination, personal data."""
