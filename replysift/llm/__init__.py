"""Operators of a training-data pipeline over document tables.

Each module holds one operator with its own general interface; ``queries.py``
has the thin registered queries and ``oracle.py`` their SQL twins. Nothing
outside this subpackage imports it.
"""
