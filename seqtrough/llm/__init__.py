"""Operators for preparing large text corpora with Spark."""
