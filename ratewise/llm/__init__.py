"""Operators for training-data pipelines.

Each module holds one operator with a general interface; ``queries.py``
registers the thin ``opN_<name>`` queries and ``oracles.py`` their SQL.
Nothing else in the library imports this subpackage.
"""
