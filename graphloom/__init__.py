"""Spark-native analytics over fact graphs, change history and measurements."""
