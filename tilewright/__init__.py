"""PySpark-native analytics over multi-resolution tile pyramids."""
