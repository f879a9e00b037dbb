"""Spark-native analytics over stored knowledge: retrieval, scoring, graphs, calibration, streams."""
