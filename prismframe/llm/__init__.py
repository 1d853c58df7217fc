"""Operators that prepare text, conversations and embeddings for training language models.

Nothing outside this subpackage imports it. ``queries.py`` holds what the driver contract registers.
"""
