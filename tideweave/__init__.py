"""Forecast-ensemble analytics as declarative Spark plans."""
