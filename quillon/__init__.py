"""Quillon: a PySpark-native analytics library over DataFrames."""
