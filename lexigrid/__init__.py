"""Spark-native building blocks for text corpora, label tables and extraction graphs."""
