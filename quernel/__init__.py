"""Spark-native analytics for language-model training data and evaluation results."""
