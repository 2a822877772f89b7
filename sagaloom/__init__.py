"""Sagaloom: narrative-knowledge analytics on Spark DataFrames."""
