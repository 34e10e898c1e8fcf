"""Operators of a training-data pipeline; nothing else in the library imports this subpackage.

Queries, and their SQL where SQL can express them, are in :mod:`tidemark.llm.registry`.
"""
