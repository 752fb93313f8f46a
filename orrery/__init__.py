"""Spark-native analytics over camera-derived spatial data."""
