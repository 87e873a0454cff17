"""PySpark-native corpus cleaning, hybrid retrieval and evaluation."""
