"""Byte-level functions: values, strings, filters, content tokens. Plain Python, no Spark."""
