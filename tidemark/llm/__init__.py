"""Operators for training-data pipelines: output formats, filters, dedup, scans.

Nothing else in the library imports this subpackage.
"""
