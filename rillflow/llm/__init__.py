"""Operators of a large-scale training-data pipeline (see ``queries.py`` for the list).

Nothing else in the library imports this subpackage.
"""
