"""Operators of a training-data pipeline on Spark.  Nothing outside this package imports it."""
