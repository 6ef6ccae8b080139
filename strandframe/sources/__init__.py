"""Readers of sequence files and texts."""
