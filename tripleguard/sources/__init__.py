"""Readers and writers of triples, vectors, logs and run records."""
