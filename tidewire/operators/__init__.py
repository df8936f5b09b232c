"""Embedding, estimators, permutations, tests."""
