"""Operators of a training-data pipeline: one module an operator, queries in ``queries.py``.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
