"""Queries and operators written with Spark's DataFrames, SQL and Structured Streaming."""
