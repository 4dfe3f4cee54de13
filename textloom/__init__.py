"""Spark batch jobs that prepare and evaluate long-document language-model data."""
