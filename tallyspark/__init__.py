"""A PySpark-native engine for transaction feeds, reconciliation, rules and training-data preparation."""
