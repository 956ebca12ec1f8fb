"""A PySpark-native knowledge-graph analytics engine."""
