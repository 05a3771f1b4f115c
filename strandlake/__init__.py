"""Sequence-assembly analytics and training-data preparation on PySpark."""
