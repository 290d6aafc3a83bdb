"""A PySpark-native analytics engine for metered-subscription usage."""
