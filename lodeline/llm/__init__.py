"""Operators for preparing training data.

Nothing else in the package imports this subpackage. Each module holds one
operator with its own interface; ``queries`` holds the thin digest queries.
"""
