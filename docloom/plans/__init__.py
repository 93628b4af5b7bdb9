"""Compositions of operators, and the corpus and queries that exercise them."""
