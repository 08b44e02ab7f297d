"""Relational, sequence, edit, scoring and evaluation operators."""
