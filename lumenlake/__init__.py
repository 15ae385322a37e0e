"""lumenlake: a PySpark-native engine for multi-channel rasters and single-cell tables."""

__version__ = "0.1.0"
