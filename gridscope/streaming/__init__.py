"""Structured Streaming forms of the row-wise and aggregate score operators."""
