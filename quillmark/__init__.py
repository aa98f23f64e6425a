"""Spark-native analytics of how well labelled groups of text can be told apart, and how much of that survives a rewrite."""
