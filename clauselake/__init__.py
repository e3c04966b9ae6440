"""Spark-native analytics over contracts and documents; see README.md for a map of the package."""
