"""Operators for preparing text corpora for model training.

Nothing else in the library imports this subpackage. The queries and their
SQL are in :mod:`gridfolk.llm.queries`.
"""
