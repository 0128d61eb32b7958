"""Structured Streaming forms of the chain operators."""
