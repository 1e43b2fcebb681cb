"""cellbasis: a PySpark-native engine for point clouds and gridded terrain products."""

__version__ = "0.1.0"
