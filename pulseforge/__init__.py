"""Spark-native analytics of annotated long ECG recordings."""
