"""Readers for delimited, line-delimited, columnar, text and binary files."""
