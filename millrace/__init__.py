"""Spark-first change capture, merge and lake ingestion engine."""
