"""Operators for preparing training text: extraction, search, tokens, filters and near duplicates.

Nothing else in the library imports this subpackage.
"""
