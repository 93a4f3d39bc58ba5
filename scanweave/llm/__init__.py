"""Operators for training-data pipelines over documents and embeddings.

Nothing else in the library imports this package; it may be removed as a whole.
"""
