"""Sonolith: annotated time-series analytics on Spark DataFrames."""
