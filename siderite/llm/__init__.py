"""Operators for text work: name mapping, product grouping, packing, mixing, truncation.

Nothing outside this subpackage imports it.
"""
