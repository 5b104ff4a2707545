"""Grammars that all compile to the same query tree."""
