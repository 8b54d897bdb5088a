"""Operators for training-data pipelines, each a Spark job over whole tables.

Nothing else in the library imports this subpackage.
"""
