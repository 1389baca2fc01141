"""A PySpark-native raster analytics engine."""
