"""A PySpark-native engine for ordered, provenance-tracked data pipelines."""
