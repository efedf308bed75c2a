"""Composite jobs (W0-W6) and the named queries over the driver tables."""
