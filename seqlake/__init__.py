"""Spark-native analytics for FASTA-style sequence collections."""
