"""Spark-native analytics for events in which groups of runners compete."""
