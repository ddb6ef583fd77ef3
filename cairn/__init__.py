"""Spark-native memory and retrieval analytics: stores of text records, search, ranking, sessions and skills as DataFrame operators."""
