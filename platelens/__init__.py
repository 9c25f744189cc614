"""Spark-native analytics over object detections in very large plate images."""
