"""Spark-native analytics over ordered, sparsely annotated collections."""
