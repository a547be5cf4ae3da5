"""Spark-native analytics over timed records: words, cues, spans, cuts and candidates."""
