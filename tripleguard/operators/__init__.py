"""Relational operators on triples."""
