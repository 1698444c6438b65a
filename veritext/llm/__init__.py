"""Operators of a training-data pipeline over the corpus tables.

Nothing outside this package imports it; the rest of the library works with
the package deleted.
"""
