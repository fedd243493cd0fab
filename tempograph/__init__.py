"""A PySpark-native engine for temporal knowledge graphs and training-data pipelines."""
