"""Scoring of arriving triples."""
