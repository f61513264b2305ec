"""Repair and forecasting of large collections of univariate time series on PySpark."""
