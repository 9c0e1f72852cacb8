"""Operators for preparing text corpora: quality, safety, deduplication, packing and formatting."""
