"""Operators for large text corpora: quality, encoding, packing, deduplication, sharding, extraction and filters."""
