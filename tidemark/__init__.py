"""Clickstream warehouse and analytics on Spark DataFrames."""
