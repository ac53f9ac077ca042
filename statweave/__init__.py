"""A PySpark-native engine for statistical knowledge graphs, retrieval and numeric evaluation."""
