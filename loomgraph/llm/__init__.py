"""Operators for preparing training text and its embeddings; nothing outside this subpackage imports it."""
