"""Spark-native analytics of the structure of public speech."""
