"""Operators of a training-data pipeline: text, tokens, embeddings and conversations."""
