"""Spark-native geospatial analytics engine."""
