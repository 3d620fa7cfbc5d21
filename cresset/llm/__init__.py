"""Operators for preparing text corpora: sampling, mapping, repair, deduplication, encoding and overlap search."""
