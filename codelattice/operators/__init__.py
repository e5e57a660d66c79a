"""Relational, graph, vector, text and hierarchy operators."""
