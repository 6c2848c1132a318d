"""Operators of a training-data pipeline: dedup, joins, tokens, quality, extraction, search, packing, URL rules.

Nothing else in the library imports this subpackage.
"""
