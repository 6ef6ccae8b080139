"""Structured Streaming readers of sequence files."""
