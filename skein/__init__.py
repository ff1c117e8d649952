"""Spark-first analytics over large text corpora."""
