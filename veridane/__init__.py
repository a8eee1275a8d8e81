"""Spark-native operators for rule-following evaluation and question-set curation."""
