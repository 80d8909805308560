"""Operators of a training-data pipeline (HTML, quality, dedup, tokens, ...).

Nothing else in the library imports this subpackage.
"""
