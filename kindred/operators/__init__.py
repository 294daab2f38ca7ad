"""Relational, graph and kernel operators."""
