"""Spark-native analytics over transcripts, timelines and corpora."""
