"""Structured Streaming forms of the line pipeline."""
