"""Operators for text corpora: extraction, duplicates, filters, packing, tokens."""
