"""Spark-native analytics over source trees, history, change sets, session logs and text corpora."""
