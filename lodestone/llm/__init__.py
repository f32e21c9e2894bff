"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it; deleting it leaves the rest of the library working.
"""
