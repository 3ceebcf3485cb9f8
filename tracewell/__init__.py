"""A PySpark-native engine for evidence analytics and training-data pipelines."""
