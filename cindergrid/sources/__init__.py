"""Readers (parquet, CSV, JSON logs) and writers."""
