"""A PySpark-native analytics engine for corpora of PDF files."""
