"""Typed filters, records and snapshot tables on PySpark."""
