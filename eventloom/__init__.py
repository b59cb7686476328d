"""Spark-native analytics for location-based events and for training corpora."""
