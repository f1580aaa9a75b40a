"""Operators for training data: clusters, membership, neighbours, tokens, leaks, subjects."""
