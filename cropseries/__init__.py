"""Spark-native analytics for satellite image time series.

Every operator takes a DataFrame and returns a DataFrame, so jobs are written as
``df.transform(op, ...)`` chains that Catalyst plans as a whole.
"""
