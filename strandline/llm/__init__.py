"""Operators of a training-data pipeline: cleaning, deduplication, tokenisation, packing, mixing.

Nothing else in the library imports this subpackage.
"""
