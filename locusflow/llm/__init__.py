"""Operators for large-scale text corpora: one module per operator.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; the thin ``opN_*`` queries live in ``queries.py``.
"""
