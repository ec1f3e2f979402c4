"""wheelgraph: a PySpark-native analytics engine for street-level accessibility data."""
