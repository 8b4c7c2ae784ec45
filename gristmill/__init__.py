"""Gristmill: a Spark-native engine for precise questions over messy business tables."""
