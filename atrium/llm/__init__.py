"""Operators for training-data pipelines over document, page and conversation tables.

Nothing else in the library imports this subpackage; it can be removed without
affecting the rest.
"""
