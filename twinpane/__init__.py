"""twinpane: a PySpark-native engine that compares old and new captures of web pages in bulk."""
