"""Operators of a training-data pipeline over document tables.

Each module holds one operator with its own interface; ``queries`` applies them
to the given tables.  Nothing outside this subpackage imports it.
"""
