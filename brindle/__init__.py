"""brindle: a PySpark-native engine for stranded intervals, gene annotations and element-by-feature data."""
