"""Spark-native engine for versioned, citation-heavy case records."""
