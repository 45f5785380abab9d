"""Operators for large training-data corpora.

Nothing outside this subpackage imports it. Every operator is a function from
DataFrames to DataFrames; ``queries`` binds them to the fixture tables.
"""
