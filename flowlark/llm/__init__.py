"""Operators for training-data corpora. Nothing outside this package imports it, except through ``__spark_entry__``."""
