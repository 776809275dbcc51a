"""Spark-native analytics for tabular sales statements and training-data corpora."""
