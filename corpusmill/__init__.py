"""Spark-first analytics over source-code corpora.

Everything public is a function from DataFrames to DataFrames; nothing here starts a session,
keeps global state or collects a table.
"""
