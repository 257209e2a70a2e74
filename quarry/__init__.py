"""A PySpark-native engine for hybrid document retrieval, redaction and evaluation."""
