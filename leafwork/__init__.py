"""Spark-first engine for repairable structured text and large text corpora."""
