"""Spark-native analytics for label maps, rasters and experiment results."""
