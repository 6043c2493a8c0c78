"""Windowed-sequence similarity analytics on Spark DataFrames."""
