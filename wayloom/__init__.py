"""Spark-native analytics over spatial room-graph maps and their edit logs."""
