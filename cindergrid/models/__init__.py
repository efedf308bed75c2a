"""Spark ML wrappers with the reference's model settings."""
