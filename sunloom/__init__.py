"""Spark-native spatio-temporal analytics: align, interpolate, window, score and evaluate sensor series as DataFrames."""
