"""Spark-first auditing and reconciliation of tabular time series."""
