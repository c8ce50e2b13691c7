"""A PySpark-native analytics engine for music and other dense time series."""
