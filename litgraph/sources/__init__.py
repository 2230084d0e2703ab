"""Readers and normalisers of article records, feeds, metadata and stored model answers."""
