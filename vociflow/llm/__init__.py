"""Operators of a training-data pipeline: dedup, packing, filters, scoring and file formats.

Nothing outside this subpackage imports it.
"""
