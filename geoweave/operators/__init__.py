"""Relational, triple and spatial operators."""
