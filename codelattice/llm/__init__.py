"""Operators for training-data pipelines: one module each, registered in ``queries.py``."""
