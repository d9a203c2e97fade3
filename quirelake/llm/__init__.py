"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface and the thin ``query`` that applies it, with
production parameters, to its whole table.
"""
