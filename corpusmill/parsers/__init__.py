"""Recursive-descent syntax checks for Python 3, JavaScript and Java 8."""
