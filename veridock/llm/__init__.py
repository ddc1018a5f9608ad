"""Operators for large training-data corpora.

Nothing outside this subpackage imports it.  Every operator takes DataFrames
and column names and returns a DataFrame; the thin ``opN_`` queries that fix
production parameters live in :mod:`veridock.llm.registry`.
"""
