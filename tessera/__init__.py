"""Columnar profiling, compression and schema reconciliation on PySpark."""
