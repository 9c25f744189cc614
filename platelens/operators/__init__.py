"""Operators over boxes, runs and labels."""
