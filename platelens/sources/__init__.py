"""Readers and writers of plates, detections, annotations and reports."""
