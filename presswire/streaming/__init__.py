"""Structured Streaming jobs over landed feed files."""
