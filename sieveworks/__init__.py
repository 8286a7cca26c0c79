"""Sieveworks: a PySpark engine for curating, sampling and judging text corpora."""
