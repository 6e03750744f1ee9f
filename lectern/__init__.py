"""Spark-native course-grounding analytics: every operator is a DataFrame or Column transformation."""
