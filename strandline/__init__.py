"""Spark-native analytics over sensor-read archives."""
