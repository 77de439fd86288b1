"""Spark-native analytics over collections of legal and policy text."""
