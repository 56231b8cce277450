"""Operators of a training-data pipeline over the table of documents.

Nothing else in the package imports this folder; it can be removed whole.
"""
