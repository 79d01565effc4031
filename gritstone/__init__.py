"""A PySpark-native engine for scanning corpora and analysing what the scan finds."""
