"""corvane: a PySpark-native hybrid document-retrieval and corpus engine."""
