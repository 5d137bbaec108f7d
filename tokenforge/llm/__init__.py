"""Operators for training-data pipelines.

Nothing else in the library imports this package; ``queries.py`` registers one
query per operator, ``corpus_pipeline.py`` at the repository top chains five of
them.
"""
