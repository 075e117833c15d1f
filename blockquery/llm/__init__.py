"""Operators for large text corpora: near-duplicates, quality, search, tokens, archives, packing, private data."""
