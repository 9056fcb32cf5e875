"""Operators for preparing training corpora: deduplication, filtering, tokenising and sharding."""
