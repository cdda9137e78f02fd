"""Operators of a training-data pipeline: ten of them, one module each.

Nothing outside this subpackage imports it.
"""
