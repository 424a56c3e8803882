"""quillspark: a PySpark-native knowledge analytics engine."""
