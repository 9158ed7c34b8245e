"""Claim and event analytics on Spark: functions from DataFrames to DataFrames."""
