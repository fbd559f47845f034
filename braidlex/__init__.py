"""Spark-native analytics for bilingual dialogue: tagging, scoring, sampling, retrieval."""
