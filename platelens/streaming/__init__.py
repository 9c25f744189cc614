"""Structured Streaming forms of the detection jobs."""
