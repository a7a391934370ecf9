"""Spark-native analytics for trip logs and place catalogues."""
