"""Spark-native state-space inference: filters, smoothers and parameter estimation over many series at once."""
