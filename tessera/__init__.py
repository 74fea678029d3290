"""Spark-native analytics for building and measuring a knowledge library."""
