"""Operators for preparing training data: text, media, vectors and shards.

Nothing else in the library imports this subpackage.  Every operator takes
DataFrames and returns DataFrames; ``queries`` binds them to the standard
tables.
"""
