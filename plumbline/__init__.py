"""A PySpark-native analytics engine for code telemetry."""
