"""Operators that a training-data pipeline needs, each built by one named method.

Nothing else in the library imports this subpackage; ``queries`` holds the
registered queries and their SQL.
"""
