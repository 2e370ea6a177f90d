"""Stateless operators over streaming DataFrames.

Operators that need no global order and no whole-column inference are column
expressions, so the same call serves a batch and a stream.
"""
