"""Spark-native analytics for moving objects in time-ordered image sequences."""
