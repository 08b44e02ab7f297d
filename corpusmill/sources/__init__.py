"""Readers and writers of the corpus tables, vocabularies and archives."""
