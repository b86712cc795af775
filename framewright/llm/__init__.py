"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it.  Every module holds one operator
with a general interface; ``queries`` holds the thin registered queries.
"""
