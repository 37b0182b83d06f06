"""Operators for preparing training text: dedup, filtering, extraction, mixing, encoding.

Nothing outside this subpackage imports it.
"""
