"""Operators for preparing training text at scale.

Each module holds one operator with a general interface (a DataFrame in, a
DataFrame out, column names and parameters as arguments); ``queries`` holds the
thin registered queries over the given tables.  Nothing outside this package
imports it.
"""
