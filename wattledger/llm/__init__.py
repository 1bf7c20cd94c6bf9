"""Operators on training data: text, tokens, embeddings and conversations."""
