"""Operators for training-data corpora: fingerprints, filters, dedup, tokens, models and chat."""
