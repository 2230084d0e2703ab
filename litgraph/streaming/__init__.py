"""Incremental forms of the pipeline on Structured Streaming."""
