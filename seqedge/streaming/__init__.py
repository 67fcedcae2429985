"""Structured Streaming over prediction files."""
