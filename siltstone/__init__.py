"""Spark-first engine for corpus engineering and evaluation analytics."""
