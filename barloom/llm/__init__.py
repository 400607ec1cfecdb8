"""Operators for large text corpora: search, near-duplicates, packing, extraction, encoding, filters."""
