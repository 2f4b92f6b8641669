"""Telemetry analytics as PySpark DataFrames."""
